"""Message logs: Kafka, or JSON files with the same columns."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fs import is_committed
from ..operators.limits import first_rows
from ..schemas import LOG, POSITIONS

DEFAULT_PARTITIONS = 8
MESSAGES_PER_FILE = 10_000
# Where a job starts: every message, those after the first start, or {topic: {partition: offset}}.
EARLIEST, LATEST = "earliest", "latest"
Starting = str | dict[str, dict[int, int]]


def to_log(
    df: DataFrame,
    key: Column,
    value: Column,
    topic: str,
    offset: Column,
    timestamp: Column,
    partition: Column | None = None,
) -> DataFrame:
    """K1: rows in log form. Messages of a key share a partition, so their offsets order
    them; ``offset`` must grow along each key's history."""
    place = F.pmod(F.xxhash64(key), F.lit(DEFAULT_PARTITIONS)) if partition is None else partition
    return df.select(
        F.lit(topic).alias("topic"),
        place.cast("int").alias("partition"),
        offset.cast("bigint").alias("offset"),
        key.cast("string").alias("key"),
        value.alias("value"),
        timestamp.alias("timestamp"),
    )


def write_files(log: DataFrame, path: str, mode: str = "append", per_file: int = MESSAGES_PER_FILE) -> None:
    """K1 to a file log, with at most ``per_file`` messages in a file."""
    log.write.mode(mode).option("maxRecordsPerFile", per_file).json(path)


def write_kafka(log: DataFrame, servers: str) -> None:
    """K1 to Kafka: the producer waits for every replica and retries."""
    (
        log.select("topic", "key", "value")
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("kafka.acks", "all")
        .option("kafka.retries", 3)
        .save()
    )


def _kafka(reader, servers: str, topic: str, starting: Starting, max_per_trigger: int | None):
    if isinstance(starting, dict):
        starting = json.dumps({t: {str(p): o for p, o in places.items()} for t, places in starting.items()})
    reader = (
        reader.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
    )
    if max_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    return reader.load().select(
        "topic",
        "partition",
        "offset",
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        "timestamp",
    )


def start_positions(spark: SparkSession, log: DataFrame, starting: Starting, checkpoint: str) -> DataFrame:
    """The last offset of each (topic, partition) that a job of this checkpoint skips.

    Found once, before the job's first start, and kept beside its offsets: a job that was down
    when messages came goes on where it stopped. Partitions that are not listed start at their
    first message. ``LATEST`` is one aggregate over the log, combined before the shuffle.
    """
    path = f"{checkpoint}/start-positions"
    if not is_committed(spark, path):
        if starting == LATEST:
            found = log.groupBy("topic", "partition").agg(F.max("offset").alias("skipped"))
        else:
            rows = [(t, int(p), int(o) - 1) for t, places in starting.items() for p, o in places.items()]
            found = spark.createDataFrame(rows, POSITIONS)
        found.write.mode("overwrite").parquet(path)
    return spark.read.schema(POSITIONS).parquet(path)


def stream(
    spark: SparkSession,
    path: str | None = None,
    servers: str | None = None,
    topic: str | None = None,
    starting: Starting | None = None,
    max_per_trigger: int | None = None,
    checkpoint: str | None = None,
    per_file: int = MESSAGES_PER_FILE,
) -> DataFrame:
    """The log as a stream, from Kafka when ``servers`` is given, else from a folder.

    The checkpoint takes the place of a consumer group; ``starting`` counts only on the
    first start: ``LATEST`` (what Kafka gets by default), ``EARLIEST`` (what a folder gets) or the
    first offsets wanted, {topic: {partition: offset}}. A folder keeps its start in the job's
    ``checkpoint``, which has to be named then.

    ``max_per_trigger`` bounds the messages of a batch. A folder's batches are whole files, so
    there the bound holds for files of at most ``per_file`` messages, as ``write_files`` makes
    them, and cannot be smaller than one file.
    """
    if servers:
        return _kafka(spark.readStream, servers, topic, starting or LATEST, max_per_trigger)
    reader = spark.readStream.schema(LOG)
    if max_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max(1, max_per_trigger // per_file))
    found = reader.json(path)
    if topic:
        found = found.filter(F.col("topic") == topic)
    if starting is None or starting == EARLIEST:
        return found
    if starting != LATEST and not isinstance(starting, dict):
        raise ValueError(f"a job starts at {EARLIEST}, {LATEST} or given offsets, not at {starting!r}")
    if checkpoint is None:
        raise ValueError("a folder's start is kept in the job's checkpoint: name it")
    skipped = start_positions(spark, batch(spark, path, topic=topic), starting, checkpoint)
    after = F.col("skipped").isNull() | (F.col("offset") > F.col("skipped"))
    return found.join(skipped, ["topic", "partition"], "left").filter(after).select(*LOG.names)


def batch(
    spark: SparkSession,
    path: str | None = None,
    servers: str | None = None,
    topic: str | None = None,
) -> DataFrame:
    """The whole log as a bounded DataFrame."""
    if servers:
        return _kafka(spark.read, servers, topic, "earliest", None)
    found = spark.read.schema(LOG).json(path)
    return found.filter(F.col("topic") == topic) if topic else found


def read_bounded(log: DataFrame, max_messages: int = 10) -> DataFrame:
    """The first messages in (partition, offset) order, with their fields if the value
    is an object."""
    v = F.col("_v")
    first = first_rows(log, max_messages, "partition", "offset")
    return first.withColumn("_v", F.try_parse_json("value")).orderBy("partition", "offset").select(
        "partition",
        "offset",
        "key",
        F.try_variant_get(v, "$.id", "string").alias("id"),
        F.try_variant_get(v, "$.text", "string").alias("text"),
        F.try_variant_get(v, "$.timestamp", "double").alias("message_timestamp"),
        F.try_variant_get(v, "$.source", "string").alias("source"),
        "value",
        "timestamp",
    )
