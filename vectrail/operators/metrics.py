"""Counters, run metrics and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_title_line
from ..schemas import RUN_RESULT

PASS_RATE = 0.8
SMOKE_RATE = 0.5

# The six columns of the summary file, with the detail column each shows.
SUMMARY_COLUMNS = {
    "Architecture": "architecture",
    "Model": "model",
    "Dataset": "dataset",
    "Chunk": "chunk_size_kb",
    "Burst_Length": "burst_length_s",
    "Result_ms": "result_ms",
}


def message_stats(messages: DataFrame, now: Column, at: str = "processed_at") -> DataFrame:
    """A1, A2: total, last hour's count, oldest and newest in a single pass."""
    return messages.agg(
        F.count("*").alias("total_messages"),
        F.count_if(F.col(at) > now - F.expr("INTERVAL 1 hour")).alias("recent_messages_1h"),
        F.min(at).alias("oldest_message"),
        F.max(at).alias("newest_message"),
    )


def stage_counters(events: DataFrame, status: Column, at: Column) -> DataFrame:
    """A3: processed, embedded and failed messages and the last time seen."""
    return events.agg(
        F.count_if(status.isin("processed", "embedded")).alias("messages_processed"),
        F.count_if(status == "embedded").alias("embeddings_generated"),
        F.count_if(status == "failed").alias("errors"),
        F.max(F.when(status != "failed", at)).alias("last_processed"),
    )


def run_metrics(runs: DataFrame, counted: str = "chunks_processed") -> DataFrame:
    """A4: latency, throughput and success from a run's counts and duration.

    ``counted`` names the count a run is judged by: processed, or persisted. Runs without
    any divide by one; durations below a millisecond count as one.
    """
    seconds = F.greatest(F.lit(0.001), F.col("duration_s"))
    done = F.col(counted)
    return runs.withColumns(
        {
            "total_duration_ms": F.col("duration_s") * 1000,
            "result_ms": F.col("duration_s") * 1000 / F.greatest(F.lit(1), done),
            "throughput_chunks_per_s": done / seconds,
            "throughput_tokens_per_s": F.col("total_tokens") / seconds,
            "success_rate": done / F.greatest(F.lit(1), F.col("chunks_produced")),
        }
    )


def summary_by_dataset(results: DataFrame) -> DataFrame:
    """A5."""
    return results.groupBy("dataset").agg(
        F.avg("throughput_chunks_per_s").alias("avg_chunks_per_s"),
        F.avg("throughput_tokens_per_s").alias("avg_tokens_per_s"),
        F.avg("success_rate").alias("avg_success_rate"),
        F.count("*").alias("total_experiments"),
        F.sum("chunks_produced").alias("total_chunks"),
        F.sum("total_tokens").alias("total_tokens"),
    )


def overall_summary(results: DataFrame) -> DataFrame:
    """How many runs worked, and their means."""
    worked = F.col("status") == "success"
    return results.agg(
        F.count("*").alias("total"),
        F.count_if(worked).alias("successful"),
        F.count_if(F.col("status") == "error").alias("failed"),
        F.avg(F.when(worked, F.col("throughput_chunks_per_s"))).alias("avg_throughput"),
        F.avg(F.when(worked, F.col("success_rate"))).alias("avg_success_rate"),
    )


def pass_threshold(results: DataFrame) -> DataFrame:
    """Runs above the pass rate, and those a smoke test would accept."""
    return results.agg(
        F.count_if(F.col("success_rate") > PASS_RATE).alias("passed"),
        F.count_if(F.col("success_rate") >= SMOKE_RATE).alias("smoke_passed"),
        F.count("*").alias("total"),
    )


def mean_by(results: DataFrame, dimension: str, measure: str) -> DataFrame:
    """A8."""
    return results.groupBy(dimension).agg(F.avg(measure).alias(f"mean_{measure}"))


def chunk_stats(chunks: DataFrame, features: dict[str, Column], text: str = "chunk") -> DataFrame:
    """Totals, averages and flagged counts over chunks."""
    return chunks.agg(
        F.count("*").alias("chunks"),
        F.sum(features["token_count"]).alias("total_tokens"),
        F.avg(features["token_count"]).alias("avg_tokens"),
        F.count_if(features["has_math"]).alias("math_chunks"),
        F.count_if(features["is_technical"]).alias("technical_chunks"),
        F.count_if(has_title_line(F.col(text))).alias("title_chunks"),
        F.floor(F.try_divide(F.sum(F.length(text)), F.count("*"))).alias("avg_length"),
    )


def corpus_report(chunks: DataFrame) -> DataFrame:
    """A10: chunks and tokens per dataset; expects columns dataset and tokens."""
    return chunks.groupBy("dataset").agg(
        F.count("*").alias("chunks"),
        F.sum("tokens").alias("total_tokens"),
        F.avg("tokens").alias("avg_tokens_per_chunk"),
    )


def model_comparison(runs: DataFrame, model: str = "model", duration_ms: str = "duration_ms") -> DataFrame:
    """Total time per model."""
    return runs.groupBy(F.coalesce(model, F.lit("default")).alias("model")).agg(
        F.sum(duration_ms).alias("total_ms"), F.count("*").alias("runs")
    )


def per_file_report(records: DataFrame) -> DataFrame:
    """Per file how many records were produced, seen and persisted, and how long it took.

    Expects file, seen, persisted (booleans) and at (timestamp).
    """
    return records.groupBy("file").agg(
        F.count("*").alias("records_produced"),
        F.count_if("seen").alias("records_seen"),
        F.count_if("persisted").alias("records_persisted"),
        ((F.unix_micros(F.max("at")) - F.unix_micros(F.min("at"))) / 1000.0).alias("duration_ms"),
    )


def burst_phase(at: Column, start: Column, interval_s: int, duration_s: int) -> Column:
    """true while sending is on: the first half of each cycle of two intervals, within
    the run's duration."""
    elapsed = F.unix_micros(at) - F.unix_micros(start)
    interval, duration = interval_s * 1_000_000, duration_s * 1_000_000
    return (F.pmod(elapsed, F.lit(2 * interval)) < interval) & (elapsed < duration) & (elapsed >= 0)


# --- result files -----------------------------------------------------------------------
def results_detailed(results: DataFrame) -> DataFrame:
    """K7: the eighteen detail columns; nulls become empty fields."""
    return results.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RUN_RESULT.fields])


def results_summary(results: DataFrame) -> DataFrame:
    """K7: the six summary columns; runs without bursts show an empty length."""
    columns = {shown: F.col(detail) for shown, detail in SUMMARY_COLUMNS.items()}
    columns["Burst_Length"] = F.coalesce(columns["Burst_Length"].cast("string"), F.lit(""))
    return results.select(*[c.alias(shown) for shown, c in columns.items()])


def write_results(results: DataFrame, path: str) -> None:
    """K7: detail and summary as CSV folders with headers."""
    for name, frame in (("detailed", results_detailed(results)), ("summary", results_summary(results))):
        frame.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(
            f"{path}/{name}"
        )
