"""The ingestion jobs.

Delivery: a checkpointed source replays a failed micro-batch under the same name, and every
sink writes that batch's folder anew, so each message counts once. A batch is named after
its stream's id, which the checkpoint keeps, and its number: a stream started afresh never
overwrites what an earlier one wrote. Failed tasks are retried by Spark; repeating a write
is harmless for the same reason.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from .. import fs
from ..functions.messages import (
    embedding_checks,
    embedding_output,
    good,
    instant,
    normalize_embedding_messages,
    parse_text_messages,
    required_field_checks,
    text_message_checks,
    with_reject_reason,
)
from ..operators.joins import unprocessed, unprocessed_in
from ..operators.tables import KeyedTable
from ..session import spread
from ..sources import log as message_log

Embed = Callable[[DataFrame], DataFrame]
POLL = "5 seconds"


def embed_with(function: Callable[[Column], Column], model_name: str) -> Embed:
    """An embedder made of a Column function; it never fails a row."""

    def run(rows: DataFrame) -> DataFrame:
        return rows.withColumns(
            {
                "embedding": function(F.col("text")),
                "model_name": F.lit(model_name),
                "embed_error": F.lit(None).cast("string"),
            }
        )

    return run


def embed_by_name(load_model, default_model: str) -> Embed:
    """An embedder that honours the model each message asks for."""
    from ..functions.embed import embed_by_model

    return lambda rows: embed_by_model(rows, load_model, default_model)


class DeadLetters:
    """Rejected messages with their reason, one folder per job and micro-batch."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows: DataFrame, name: str) -> None:
        (
            rows.filter("reject_reason is not null")
            .select("key", "value", "reject_reason")
            .write.mode("overwrite")
            .parquet(f"{self.path}/batch={name}")
        )

    def read(self, spark: SparkSession) -> DataFrame:
        """Everything refused so far; no rows before the first batch."""
        names = [n for n in fs.children(spark, self.path) if fs.is_committed(spark, f"{self.path}/{n}")]
        shape = "key string, value string, reject_reason string"
        if not names:
            return spark.createDataFrame([], shape)
        return spark.read.schema(shape).parquet(*[f"{self.path}/{n}" for n in names])


# What a body does with a batch of that name; it gives the batch's counts, or nothing.
Body = Callable[[DataFrame, str], dict | None]


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """Cached for as long as a batch works on it, also when the batch fails."""
    df.persist()
    try:
        yield df
    finally:
        df.unpersist()


def run(
    stream: DataFrame,
    name: str,
    checkpoint: str,
    body: Body,
    every: str | None = POLL,
    once: bool = False,
    report: ProgressReport | None = None,
) -> StreamingQuery:
    """Start a job; ``body`` gets each micro-batch and its name. ``once`` drains what is
    there and stops (T6). ``report`` adds up the counts of finished batches (T8)."""
    stream_id = []

    def each_batch(batch: DataFrame, number: int) -> None:
        if not stream_id:
            kept = batch.sparkSession.read.schema("id string").json(f"{checkpoint}/metadata")
            stream_id.append(kept.first().id)
        counts = body(batch, f"{stream_id[0]}.{number:09d}")
        if report is not None and counts:
            report.add(stream_id[0], counts)

    writer = (
        stream.writeStream.queryName(name)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(each_batch)
    )
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def drain(query: StreamingQuery) -> None:
    """Wait for a run-once job; a failure of the job is raised here."""
    query.awaitTermination()


def refused(checked: DataFrame, embedded: DataFrame | None = None, time: Column | None = None) -> DataFrame:
    """All messages with the ``reject_reason`` of those that failed a check, and once more those the
    model failed on; ``time`` is a message's own."""
    time = F.lit(None).cast("timestamp") if time is None else time
    rows = checked.select("key", "value", "reject_reason", time.alias("time"))
    if embedded is None:
        return rows
    failed = embedded.filter("embed_error is not null")
    return rows.unionByName(
        failed.select("key", "value", F.lit("embedding_failed").alias("reject_reason"), F.lit(None).cast("timestamp").alias("time"))
    )


def set_aside(rows: DataFrame, dead: DeadLetters | None, name: str, embeds: bool) -> dict:
    """Write what was refused and count the batch on the way, in one pass.

    ``refused`` are messages that failed a check, ``failed`` those the model failed on; ``newest`` is
    the latest time that a message names.
    """
    reason, seen = F.coalesce("reject_reason", F.lit("")), Observation()
    failed = reason == "embedding_failed"
    watched = rows.observe(
        seen,
        F.count_if(~failed).alias("processed"),
        F.count_if((reason != "") & ~failed).alias("refused"),
        F.count_if(failed).alias("failed"),
        F.max("time").alias("newest"),
    )
    if dead is not None:
        dead.write(watched, name)
    else:
        watched.write.format("noop").mode("overwrite").save()
    counts = dict(seen.get)
    counts["embedded"] = counts["processed"] - counts["refused"] - counts["failed"] if embeds else 0
    return counts


# --- batch bodies -----------------------------------------------------------------------
def embed_batch(embed: Embed, sink: Body, now: Column, dead: DeadLetters | None):
    """Refuse unreadable and blank messages, embed the rest, emit output messages."""

    def body(batch: DataFrame, name: str) -> dict:
        rows = with_reject_reason(parse_text_messages(spread(batch)), text_message_checks())
        with held(rows) as checked, held(embed(good(checked))) as embedded:
            output = embedded.filter("embed_error is null")
            sink(
                message_log.to_log(
                    output,
                    key=F.col("id"),
                    value=embedding_output(now),
                    topic="embeddings",
                    offset=F.col("offset"),
                    timestamp=now,
                    partition=F.col("partition"),
                ),
                name,
            )
            return set_aside(refused(checked, embedded, instant(F.col("input_timestamp"))), dead, name, embeds=True)

    return body


def writer_batch(table: KeyedTable, now: Column, dim: int | None, dead: DeadLetters | None):
    """Normalise embedding messages and upsert them into their destinations."""

    def body(batch: DataFrame, name: str) -> dict:
        raw = batch.withColumn("raw_value", F.col("value"))
        rows = normalize_embedding_messages(raw, now).withColumnsRenamed(
            {"log_key": "key", "raw_value": "value"}
        )
        with held(with_reject_reason(rows, embedding_checks(dim))) as checked:
            table.append(good(checked), name, order=["partition", "offset"])
            return set_aside(refused(checked, time=F.col("timestamp")), dead, name, embeds=False)

    return body


def embed_store_batch(table: KeyedTable, embed: Embed, now: Column, dead: DeadLetters | None):
    """Parse, embed and upsert in one job; a message without a time gets the present."""

    def body(batch: DataFrame, name: str) -> dict:
        time = F.col("input_timestamp")
        odd_time = {"invalid_timestamp": time.isNotNull() & instant(time).isNull()}
        parsed = with_reject_reason(parse_text_messages(spread(batch)), text_message_checks() | odd_time)
        with held(parsed) as checked, held(embed(good(checked))) as embedded:
            rows = embedded.filter("embed_error is null").select(
                "id",
                "text",
                "embedding",
                F.coalesce(instant(time), now).alias("created_at"),
                now.alias("processed_at"),
                "partition",
                "offset",
            )
            table.append(rows, name, order=["partition", "offset"])
            return set_aside(refused(checked, embedded, instant(time)), dead, name, embeds=True)

    return body


def text_writer_batch(table: KeyedTable, now: Column, dead: DeadLetters | None, source: str = "kafka"):
    """T4: store new messages; an id that is already there keeps its row."""

    def body(batch: DataFrame, name: str) -> dict:
        with held(with_reject_reason(parse_text_messages(batch), required_field_checks())) as checked:
            rows = good(checked).select(
                "id",
                F.col("text").alias("content"),
                F.lit(source).alias("source"),
                now.alias("created_at"),
                now.alias("processed_at"),
                "partition",
                "offset",
            )
            table.append(rows, name, order=["partition", "offset"])
            return set_aside(refused(checked, time=instant(F.col("input_timestamp"))), dead, name, embeds=False)

    return body


def embed_messages(messages: DataFrame, embed: Embed, now: Column) -> DataFrame:
    """Pending messages (id, content, created_at) as rows of the embeddings table, ranked
    by the age of the message."""
    return embedded_rows(embed(messages.withColumnRenamed("content", "text")), now)


def embedded_rows(embedded: DataFrame, now: Column) -> DataFrame:
    return embedded.filter("embed_error is null").select(
        F.col("id").alias("text_message_id"),
        F.col("text").alias("text_content"),
        "embedding",
        now.alias("created_at"),
        F.col("created_at").alias("message_created_at"),
    )


OLDEST_FIRST = ["message_created_at", "text_content"]


def failed_messages(embedded: DataFrame) -> DataFrame:
    """Messages the model failed on, as dead letters: the id and the text."""
    return embedded.filter("embed_error is not null").select(
        F.col("id").alias("key"), F.col("text").alias("value"), F.lit("embedding_failed").alias("reject_reason")
    )


def incremental_embed_batch(table: KeyedTable, embed: Embed, now: Column, dead: DeadLetters):
    """T5: of the messages that arrived, embed those without an embedding.

    The checkpoint stands in for the poller's last timestamp, so late and equal times
    are not lost. Messages the model fails on go to ``dead``, from where ``retry_failed``
    takes them up again: what is stored and what is set aside are all messages. The table is
    asked once a batch, by the batch's ids, and is not shuffled.
    """

    def body(batch: DataFrame, name: str) -> dict:
        with held(spread(batch.select("id", "content", "created_at"), "id")) as arrived:
            pending = unprocessed_in(arrived, table.read(before=name))
            with held(embed(pending.withColumnRenamed("content", "text"))) as embedded:
                table.append(embedded_rows(embedded, now), name, order=OLDEST_FIRST, known_new=True)
                taken = embedded.select(
                    F.col("id").alias("key"), F.col("text").alias("value"), F.lit(None).cast("string").alias("reject_reason"), "embed_error", "created_at"
                )
                return set_aside(refused(taken, taken, F.col("created_at")), dead, name, embeds=True)

    return body


def process_pending(
    messages: DataFrame,
    table: KeyedTable,
    embed: Embed,
    now: Column,
    dead: DeadLetters,
    batch_size: int | None = 10,
) -> int:
    """One round of the poller, by hand: embed the oldest pending messages and give the
    number taken up.

    Messages the model fails on are set aside in ``dead`` and no later round takes them again,
    so a failing message blocks nothing.
    """
    aside = dead.read(messages.sparkSession).filter("reject_reason = 'embedding_failed'")
    messages = messages.join(aside.select(F.col("key").alias("id")), "id", "left_anti")
    return _embed_pending(messages, table, embed, now, batch_size, dead)


def _embed_pending(messages: DataFrame, table: KeyedTable, embed: Embed, now: Column, batch_size: int | None, dead: DeadLetters | None) -> int:
    pending = spread(unprocessed(messages, table.read(), batch_size), "id").persist()
    embedded = embed(pending.withColumnRenamed("content", "text")).persist()
    try:
        count = pending.count()
        if count:
            name = str(table.next_batch())
            if dead is not None:
                dead.write(failed_messages(embedded), f"pending-{name}")
            table.append(embedded_rows(embedded, now), name, order=OLDEST_FIRST)
        return count
    finally:
        embedded.unpersist()
        pending.unpersist()


def retry_failed(
    messages: DataFrame, table: KeyedTable, embed: Embed, now: Column, dead: DeadLetters
) -> int:
    """Embed once more the messages that were set aside and are still without an embedding."""
    aside = dead.read(messages.sparkSession).filter("reject_reason = 'embedding_failed'")
    again = messages.join(aside.select(F.col("key").alias("id")), "id", "left_semi")
    return _embed_pending(again, table, embed, now, None, None)


def file_sink(path: str) -> Body:
    """K1 from a stream to a file log; a replayed batch replaces its folder."""
    return lambda rows, name: message_log.write_files(
        rows, f"{path}/batch={name}", mode="overwrite"
    )


def kafka_sink(servers: str) -> Body:
    """K1 from a stream to Kafka: at least once; the writer's upsert absorbs repeats."""
    return lambda rows, _: message_log.write_kafka(rows, servers)


class ProgressReport(StreamingQueryListener):
    """Per job the rows read, batches, last trigger and error; given to ``run``, also the messages
    processed, embedded, refused and failed, and the newest time of a message.

    Counts are those of finished batches since the report was made: a batch that fails is counted
    when its replay ends. Messages that a poller finds embedded already are not counted.
    """

    def __init__(self):
        self.jobs: dict[str, dict] = {}
        self._lock = threading.Lock()  # batches and events come from different threads

    def _job(self, id) -> dict:
        return self.jobs.setdefault(
            str(id),
            {
                "name": None, "running": True, "batches": 0, "rows": 0, "last": None, "error": None,
                "processed": 0, "embedded": 0, "refused": 0, "failed": 0, "newest": None,
            },
        )

    def add(self, id, counts: dict) -> None:
        with self._lock:
            job = self._job(id)
            for name in ("processed", "embedded", "refused", "failed"):
                job[name] += counts[name]
            times = [t for t in (job["newest"], counts["newest"]) if t is not None]
            job["newest"] = max(times, default=None)

    def onQueryStarted(self, event):
        with self._lock:
            self._job(event.id)["name"] = event.name

    def onQueryProgress(self, event):
        with self._lock:
            job = self._job(event.progress.id)
            job["batches"] += 1
            job["rows"] += event.progress.numInputRows
            job["last"] = event.progress.timestamp

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        with self._lock:
            job = self._job(event.id)
            job["running"], job["error"] = False, event.exception
