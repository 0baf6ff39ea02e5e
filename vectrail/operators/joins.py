"""Set questions between stages of an ingestion run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keyed import BROADCAST_KEYS, without_existing


def unprocessed(
    messages: DataFrame,
    embeddings: DataFrame,
    batch_size: int | None = None,
    after: Column | None = None,
) -> DataFrame:
    """Messages without an embedding, oldest first.

    Written as an anti-join on the unique message id. ``after`` adds the creation-time
    bound of a poller; by itself it would lose late rows, so it is off by default.
    """
    pending = messages.select("id", "content", "created_at")
    if after is not None:
        pending = pending.filter(F.col("created_at") > after)
    done = embeddings.select(F.col("text_message_id").alias("id"))
    pending = pending.join(done, "id", "left_anti")
    if batch_size is None:
        return pending
    return pending.orderBy("created_at", "id").limit(batch_size)


def unprocessed_in(batch: DataFrame, embeddings: DataFrame) -> DataFrame:
    """J1 for a batch that arrived: those of its messages without an embedding.

    The batch's ids travel to the table and the hits come back, so the table is not shuffled.
    ``batch`` is used more than once; callers persist it.
    """
    pending = batch.select("id", "content", "created_at")
    return without_existing(pending, embeddings.select(F.col("text_message_id").alias("id")), ["id"])


def reconcile(produced: DataFrame, stages: dict[str, DataFrame], id: str = "id") -> DataFrame:
    """Every produced id with one flag per stage that saw it.

    All id sets go through one aggregation that combines before its single shuffle, so
    repeated ids cost nothing extra. When the run is small next to its tables, its ids
    are broadcast first and only matching ids reach the shuffle.
    """
    ids = produced.select(id)
    small = ids.count() <= BROADCAST_KEYS
    tagged = ids.withColumn("stage", F.lit(""))
    for name, seen in stages.items():
        seen = seen.select(id)
        if small:
            seen = seen.join(F.broadcast(ids), id, "left_semi")
        tagged = tagged.unionByName(seen.withColumn("stage", F.lit(name)))

    def saw(name: str) -> Column:
        return F.bool_or(F.col("stage") == name)

    return (
        tagged.groupBy(id)
        .agg(saw("").alias("_produced"), *[saw(name).alias(name) for name in stages])
        .filter("_produced")
        .drop("_produced")
    )


def stage_latency(
    log: DataFrame,
    id: str,
    stage: str,
    at: str,
    start: str = "start",
    produced: str = "produced",
    embedded: str = "embedded",
    finished: str = "finished",
) -> DataFrame:
    """Per message the total, produce-to-embed and embed-to-persist time in ms.

    A missing stage makes the figures that need it null. The first event of a stage
    counts. One conditional aggregation replaces a join per stage.
    """

    def when(name: str) -> Column:
        return F.min(F.when(F.col(stage) == name, F.unix_micros(F.col(at))))

    per_id = log.groupBy(id).agg(
        when(start).alias("_start"),
        when(produced).alias("_produced"),
        when(embedded).alias("_embedded"),
        when(finished).alias("_finished"),
    )
    return per_id.select(
        id,
        ((F.col("_finished") - F.col("_start")) / 1000.0).alias("total_ms"),
        ((F.col("_embedded") - F.col("_produced")) / 1000.0).alias("produce_to_embed_ms"),
        ((F.col("_finished") - F.col("_embedded")) / 1000.0).alias("embed_to_persist_ms"),
    )


def experiment_grid(
    datasets: DataFrame,
    chunk_sizes_kb: Sequence[float],
    burst_durations_s: Sequence[int],
    burst_interval_s: int,
) -> DataFrame:
    """Each dataset with every chunk size, once without and once per burst length.

    The sizes and bursts are short constant lists, so each dataset row expands in place.
    """
    bursts = F.lit([None, *burst_durations_s]).cast("array<int>") if burst_durations_s else F.array(
        F.lit(None).cast("int")
    )
    return (
        datasets.select("dataset", F.explode(F.lit(list(chunk_sizes_kb))).alias("chunk_size_kb"))
        .select("dataset", "chunk_size_kb", F.explode(bursts).alias("burst_length_s"))
        .select(
            "dataset",
            "chunk_size_kb",
            F.col("burst_length_s").isNotNull().alias("burst_enabled"),
            "burst_length_s",
            F.when(F.col("burst_length_s").isNotNull(), burst_interval_s).alias("burst_interval_s"),
        )
    )


def orphans(embeddings: DataFrame, messages: DataFrame) -> DataFrame:
    """Embeddings whose message does not exist."""
    known = messages.select(F.col("id").alias("text_message_id"))
    return embeddings.join(known, "text_message_id", "left_anti")
