"""Run metrics and reports over runs read off the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins
from ..operators import metrics as ops
from ..schemas import RUN_RESULT
from ..session import new_scratch
from .inputs import BASE, MESSAGES_SQL, messages, now, table
from .registry import plan


def micros(column: str = "ts"):
    """Event times as instants; the session runs in UTC."""
    return F.col(column).cast("timestamp")


def runs(spark, sf):
    """One run per user: events are chunks, errors are lost ones."""
    user = F.col("user_id")
    events = table(spark, sf, "events").withColumn("at", micros())
    counted = events.groupBy("user_id").agg(
        F.count("*").alias("chunks_produced"),
        F.count_if(F.col("event_type") != "error").alias("chunks_processed"),
        F.count_if(F.col("event_type").isin("click", "purchase", "signup")).alias("chunks_persisted"),
        F.sum(F.floor("value")).alias("total_tokens"),
        ((F.unix_micros(F.max("at")) - F.unix_micros(F.min("at"))) / 1e6).alias("duration_s"),
    )
    bursts = user % 3 != 0
    return counted.select(
        "*",
        F.lit("stream").alias("architecture"),
        F.concat(F.lit("model-"), user % 2).alias("model"),
        F.element_at(F.array(*map(F.lit, ("cc_news", "arxiv", "wikipedia"))), (user % 3 + 1).cast("int")).alias("dataset"),
        F.pow(F.lit(2.0), user % 4).alias("chunk_size_kb"),
        F.when(bursts, (user % 5).cast("int")).alias("burst_length_s"),
        (F.lit(256) * F.pow(F.lit(2.0), user % 4)).cast("int").alias("chunk_size_tokens"),
        bursts.alias("burst_enabled"),
        F.when(bursts, 2).alias("burst_interval_s"),
        F.when(user % 7 == 0, "error").otherwise("success").alias("status"),
        F.when(user % 7 == 0, "lost").alias("error_message"),
    )


RUNS_SQL = """
counted AS (
  SELECT user_id, count(*) AS chunks_produced, count(*) FILTER (event_type <> 'error') AS chunks_processed,
         count(*) FILTER (event_type IN ('click', 'purchase', 'signup')) AS chunks_persisted,
         CAST(sum(floor(value)) AS BIGINT) AS total_tokens,
         (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration_s
  FROM events GROUP BY user_id),
runs AS (
  SELECT *, 'stream' AS architecture, 'model-' || user_id % 2 AS model,
         ['cc_news', 'arxiv', 'wikipedia'][user_id % 3 + 1] AS dataset, CAST(2 ** (user_id % 4) AS DOUBLE) AS chunk_size_kb,
         CASE WHEN user_id % 3 <> 0 THEN CAST(user_id % 5 AS INTEGER) END AS burst_length_s,
         CAST(256 * 2 ** (user_id % 4) AS INTEGER) AS chunk_size_tokens, user_id % 3 <> 0 AS burst_enabled,
         CASE WHEN user_id % 3 <> 0 THEN 2 END AS burst_interval_s,
         CASE WHEN user_id % 7 = 0 THEN 'error' ELSE 'success' END AS status,
         CASE WHEN user_id % 7 = 0 THEN 'lost' END AS error_message
  FROM counted),
results AS (
  SELECT *, duration_s * 1000 AS total_duration_ms, duration_s * 1000 / greatest(1, chunks_processed) AS result_ms,
         chunks_processed / greatest(0.001, duration_s) AS throughput_chunks_per_s,
         total_tokens / greatest(0.001, duration_s) AS throughput_tokens_per_s,
         chunks_processed / greatest(1, chunks_produced) AS success_rate
  FROM runs)"""


def results(spark, sf):
    return ops.run_metrics(runs(spark, sf))


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, digits(c)) for c in columns})


def digits(column: str) -> int:
    """Milliseconds run into the billions, rates stay small."""
    return 3 if column.endswith("_ms") else 6


MEASURES = (
    "total_duration_ms", "result_ms", "throughput_chunks_per_s", "throughput_tokens_per_s", "success_rate",
)


@plan(f"""WITH {RUNS_SQL} SELECT user_id, chunks_processed,
  {", ".join(MEASURES)} FROM results""")
def run_metrics(spark, sf):
    return results(spark, sf).select("user_id", "chunks_processed", *MEASURES)


@plan(f"""WITH {RUNS_SQL} SELECT user_id,
  duration_s * 1000 / greatest(1, chunks_persisted) AS result_ms,
  chunks_persisted / greatest(1, chunks_produced) AS success_rate FROM results""")
def run_metrics_persisted(spark, sf):
    """The same with runs judged by what was persisted."""
    judged = ops.run_metrics(runs(spark, sf), counted="chunks_persisted")
    return judged.select("user_id", "result_ms", "success_rate")


@plan(f"""WITH {RUNS_SQL}
SELECT dataset, round(avg(throughput_chunks_per_s), 6) AS avg_chunks_per_s,
       round(avg(throughput_tokens_per_s), 6) AS avg_tokens_per_s, round(avg(success_rate), 6) AS avg_success_rate,
       count(*) AS total_experiments, CAST(sum(chunks_produced) AS BIGINT) AS total_chunks,
       CAST(sum(total_tokens) AS BIGINT) AS total_tokens
FROM results GROUP BY dataset""")
def summary_by_dataset(spark, sf):
    return rounded(
        ops.summary_by_dataset(results(spark, sf)), "avg_chunks_per_s", "avg_tokens_per_s", "avg_success_rate"
    )


@plan(f"""WITH {RUNS_SQL}
SELECT count(*) AS total, count(*) FILTER (status = 'success') AS successful, count(*) FILTER (status = 'error') AS failed,
       round(avg(throughput_chunks_per_s) FILTER (status = 'success'), 6) AS avg_throughput,
       round(avg(success_rate) FILTER (status = 'success'), 6) AS avg_success_rate
FROM results""")
def overall_summary(spark, sf):
    return rounded(ops.overall_summary(results(spark, sf)), "avg_throughput", "avg_success_rate")


@plan(f"""WITH {RUNS_SQL}
SELECT count(*) FILTER (success_rate > 0.8) AS passed, count(*) FILTER (success_rate >= 0.5) AS smoke_passed,
       count(*) AS total FROM results""")
def pass_threshold(spark, sf):
    return ops.pass_threshold(results(spark, sf))


@plan(f"""WITH {RUNS_SQL} SELECT dataset, round(avg(throughput_chunks_per_s), 6) AS mean_throughput_chunks_per_s
FROM results GROUP BY dataset""")
def mean_by_dataset(spark, sf):
    return rounded(
        ops.mean_by(results(spark, sf), "dataset", "throughput_chunks_per_s"), "mean_throughput_chunks_per_s"
    )


@plan(f"""WITH {RUNS_SQL} SELECT burst_enabled, round(avg(result_ms), 3) AS mean_result_ms
FROM results GROUP BY burst_enabled""")
def mean_by_burst(spark, sf):
    return rounded(ops.mean_by(results(spark, sf), "burst_enabled", "result_ms"), "mean_result_ms")


@plan(f"""WITH {RUNS_SQL} SELECT chunk_size_kb, round(avg(success_rate), 6) AS mean_success_rate
FROM results GROUP BY chunk_size_kb""")
def mean_by_chunk_size(spark, sf):
    return rounded(ops.mean_by(results(spark, sf), "chunk_size_kb", "success_rate"), "mean_success_rate")


@plan(f"""WITH {RUNS_SQL}
SELECT model, round(sum(duration_s * 1000), 3) AS total_ms, count(*) AS runs FROM results GROUP BY model""")
def model_comparison(spark, sf):
    timed = runs(spark, sf).withColumn("duration_ms", F.col("duration_s") * 1000)
    return ops.model_comparison(timed).withColumn("total_ms", F.round("total_ms", 3))


@plan("""
SELECT event_type AS file, count(*) AS records_produced, count(*) FILTER (value > 10) AS records_seen,
       count(*) FILTER (value > 50) AS records_persisted,
       round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000.0, 3) AS duration_ms
FROM events GROUP BY event_type""")
def per_file_report(spark, sf):
    records = table(spark, sf, "events").select(
        F.col("event_type").alias("file"),
        (F.col("value") > 10).alias("seen"),
        (F.col("value") > 50).alias("persisted"),
        micros().alias("at"),
    )
    return ops.per_file_report(records).withColumn("duration_ms", F.round("duration_ms", 3))


@plan("""
SELECT user_id, round((f - s) / 1000.0, 3) AS total_ms, round((e - p) / 1000.0, 3) AS produce_to_embed_ms,
       round((f - e) / 1000.0, 3) AS embed_to_persist_ms
FROM (SELECT user_id, epoch_us(min(ts) FILTER (event_type = 'signup')) AS s,
             epoch_us(min(ts) FILTER (event_type = 'view')) AS p,
             epoch_us(min(ts) FILTER (event_type = 'click' AND user_id % 10 > 0)) AS e,
             epoch_us(min(ts) FILTER (event_type = 'purchase')) AS f
      FROM events GROUP BY user_id)""")
def stage_latency(spark, sf):
    """Some users never reach the embedding stage, which leaves two of the figures null."""
    stage = F.when((F.col("event_type") != "click") | (F.col("user_id") % 10 > 0), F.col("event_type"))
    log = table(spark, sf, "events").select("user_id", stage.alias("stage"), micros().alias("at"))
    found = joins.stage_latency(
        log, "user_id", "stage", "at", start="signup", produced="view", embedded="click", finished="purchase"
    )
    return found.select(
        "user_id", *[F.round(c, 3).alias(c) for c in ("total_ms", "produce_to_embed_ms", "embed_to_persist_ms")]
    )


@plan("""
SELECT dataset, CAST(kb AS DOUBLE) AS chunk_size_kb, burst IS NOT NULL AS burst_enabled, burst AS burst_length_s,
       CASE WHEN burst IS NOT NULL THEN 2 END AS burst_interval_s
FROM (SELECT dataset, kb, unnest([NULL, 1, 5, 10, 15, 30, 45, 60]) AS burst
      FROM (SELECT dataset, unnest([0.5, 1, 2, 5, 10, 20, 40, 80]) AS kb
            FROM (SELECT DISTINCT source AS dataset FROM documents)))""")
def experiment_grid(spark, sf):
    """The published grid of sizes and bursts for every source of documents."""
    datasets = table(spark, sf, "documents").select(F.col("source").alias("dataset")).distinct()
    return joins.experiment_grid(
        datasets, [0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 40.0, 80.0], [1, 5, 10, 15, 30, 45, 60], 2
    )


@plan(f"""WITH {MESSAGES_SQL}
SELECT count(*) AS total_messages, count(*) FILTER (processed_at > {BASE + 1800}) AS recent_messages_1h,
       min(processed_at) AS oldest_message, max(processed_at) AS newest_message FROM messages""")
def message_stats(spark, sf):
    return ops.message_stats(messages(spark, sf), now()).withColumns(
        {c: F.unix_seconds(c) for c in ("oldest_message", "newest_message")}
    )


@plan("SELECT count(*) AS row_count FROM documents")
def count_rows(spark, sf):
    return table(spark, sf, "documents").agg(F.count("*").alias("row_count"))


@plan("""
SELECT count(*) FILTER (event_type <> 'error') AS messages_processed,
       count(*) FILTER (event_type IN ('click', 'purchase')) AS embeddings_generated,
       count(*) FILTER (event_type = 'error') AS errors,
       epoch_us(max(ts) FILTER (event_type <> 'error')) AS last_processed FROM events""")
def stage_counters(spark, sf):
    kind = F.col("event_type")
    status = F.when(kind == "error", "failed").when(kind.isin("click", "purchase"), "embedded").otherwise("processed")
    return ops.stage_counters(table(spark, sf, "events"), status, micros()).withColumn(
        "last_processed", F.unix_micros("last_processed")
    )


INTERVAL, DURATION = 6 * 3600, 20 * 86400


@plan(f"""
SELECT event_id, el % {2 * INTERVAL * 1_000_000} < {INTERVAL * 1_000_000} AND el < {DURATION * 1_000_000} AS sending
FROM (SELECT event_id, epoch_us(ts) - {BASE}000000 AS el FROM events)""")
def burst_phase(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", ops.burst_phase(micros(), now(BASE), INTERVAL, DURATION).alias("sending")
    )


# --- result files ---------------------------------------------------------------------------
def written(spark, sf):
    path = new_scratch(spark, "results")
    ops.write_results(results(spark, sf), path)
    return path


@plan(f"""WITH {RUNS_SQL}
SELECT architecture AS "Architecture", model AS "Model", dataset AS "Dataset", chunk_size_kb AS "Chunk",
       coalesce(CAST(burst_length_s AS VARCHAR), '') AS "Burst_Length", result_ms AS "Result_ms" FROM results""")
def results_summary(spark, sf):
    """Written as CSV and read back."""
    schema = "Architecture string, Model string, Dataset string, Chunk double, Burst_Length string, Result_ms double"
    back = spark.read.schema(schema).option("header", True).csv(f"{written(spark, sf)}/summary")
    return back.withColumn("Burst_Length", F.coalesce("Burst_Length", F.lit("")))


DETAIL = [f.name for f in RUN_RESULT.fields]


@plan(f"""WITH {RUNS_SQL} SELECT
{", ".join(DETAIL)} FROM results""")
def results_detailed(spark, sf):
    return spark.read.schema(RUN_RESULT).option("header", True).csv(f"{written(spark, sf)}/detailed")
