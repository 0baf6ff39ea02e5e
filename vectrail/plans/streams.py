"""Streaming jobs, run once over whole tables written as a file log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.embed import embed_hash
from ..operators.tables import KeyedTable, routed_table
from ..schemas import EMBEDDINGS, LOG, STREAM_EMBEDDINGS, TEXT_EMBEDDINGS, TEXT_MESSAGES
from ..session import new_scratch
from ..sources import log
from ..streaming import jobs
from .inputs import BASE, MESSAGES_SQL, NOW, messages, now, sql_embed, staged, table
from .messages import conversation_files, event_log
from .registry import plan

DIM = 64
EMBED = jobs.embed_with(lambda text: embed_hash(text, DIM), "stand-in")


def run_once(source, name, root, body):
    jobs.drain(jobs.run(source, name, f"{root}/checkpoint-{name}", body, once=True))


def document_files(spark, sf) -> str:
    """Every document as a text message in a file log."""
    from ..functions.messages import envelope

    docs = messages(spark, sf)
    value = envelope(
        id=F.col("id"),
        text=F.col("content"),
        timestamp=F.unix_seconds("created_at").cast("double"),
        source=F.col("source"),
    )
    return staged(
        spark,
        sf,
        "document-log",
        lambda path: log.write_files(
            log.to_log(
                docs,
                key=F.col("id"),
                value=value,
                topic="text-messages",
                offset=F.col("id").cast("bigint"),
                timestamp=F.col("created_at"),
            ),
            path,
        ),
    )


def embedded_files(spark, sf) -> str:
    """The output log of the embedding job over every document."""
    def write(path):
        source = log.stream(spark, document_files(spark, sf))
        run_once(source, "embed", f"{path}-job", jobs.embed_batch(EMBED, jobs.file_sink(path), now(), None))

    return staged(spark, sf, "embedded-log", write)


FIRST = "round(CAST(embedding[1] AS DOUBLE), 5) AS first_value"
EMBEDDED = sql_embed("messages", "embedded", "content", DIM)


@plan(f"""
WITH {MESSAGES_SQL}, {EMBEDDED}
SELECT id AS key, id, md5(content) AS original_text, 'stand-in' AS model_name, {DIM} AS embedding_dimension,
       CAST(created_at AS DOUBLE) AS input_timestamp, source AS input_source, {FIRST} FROM embedded""")
def stream_embed(spark, sf):
    """Log to log: every message comes out with its vector."""
    out = log.batch(spark, embedded_files(spark, sf), topic="embeddings")
    v = F.col("v")
    return out.select("key", F.parse_json("value").alias("v")).select(
        "key",
        F.variant_get(v, "$.id", "string").alias("id"),
        F.md5(F.variant_get(v, "$.original_text", "string")).alias("original_text"),
        F.variant_get(v, "$.model_name", "string").alias("model_name"),
        F.variant_get(v, "$.embedding_dimension", "int").alias("embedding_dimension"),
        F.variant_get(v, "$.input_timestamp", "double").alias("input_timestamp"),
        F.variant_get(v, "$.input_source", "string").alias("input_source"),
        F.round(F.variant_get(v, "$.embedding[0]", "float").cast("double"), 5).alias("first_value"),
    )


@plan(f"""
WITH {MESSAGES_SQL}, {EMBEDDED}
SELECT 'embeddings' AS table_name, id, md5(content) AS text, {NOW} AS timestamp, 'stand-in' AS source, '{{}}' AS metadata, {FIRST}
FROM embedded""")
def stream_upsert(spark, sf):
    """The embedding job's log into the writer's tables."""
    root = new_scratch(spark, "writer")
    store = routed_table(spark, f"{root}/tables", EMBEDDINGS)
    source = log.stream(spark, embedded_files(spark, sf) + "/batch=*", topic="embeddings")
    run_once(source, "writer", root, jobs.writer_batch(store, now(), DIM, jobs.DeadLetters(f"{root}/dead")))
    return store.read().select(
        "table_name",
        "id",
        F.md5("text").alias("text"),
        F.unix_seconds("timestamp").cast("int").alias("timestamp"),
        "source",
        "metadata",
        F.round(F.get("embedding", 0).cast("double"), 5).alias("first_value"),
    )


@plan(f"""
WITH good AS (
  SELECT conv_id, arg_max(text, turn) AS text, max(turn) AS turn FROM conversations WHERE role <> 'system' GROUP BY conv_id),
{sql_embed('good', 'embedded', 'text', DIM)}
SELECT CAST(conv_id AS VARCHAR) AS id, md5(text) AS text, {BASE} + turn AS created_at, {FIRST} FROM embedded""")
def stream_embed_store(spark, sf):
    """Parse, embed and upsert in one job; each conversation ends at its last turn."""
    root = new_scratch(spark, "embed-store")
    store = KeyedTable(spark, f"{root}/table", STREAM_EMBEDDINGS, key=["id"])
    source = log.stream(spark, conversation_files(spark, sf))
    run_once(
        source, "embed-store", root, jobs.embed_store_batch(store, EMBED, now(), jobs.DeadLetters(f"{root}/dead"))
    )
    return store.read().select(
        "id",
        F.md5("text").alias("text"),
        F.unix_seconds("created_at").alias("created_at"),
        F.round(F.get("embedding", 0).cast("double"), 5).alias("first_value"),
    )


@plan("""
SELECT CAST(conv_id AS VARCHAR) AS id, md5(arg_min(text, turn)) AS content, 'kafka' AS source
FROM conversations WHERE role <> 'system' GROUP BY conv_id""")
def stream_insert_if_absent(spark, sf):
    """The text writer: each conversation keeps its first turn that has a text."""
    root = new_scratch(spark, "text-writer")
    store = KeyedTable(spark, f"{root}/table", TEXT_MESSAGES, key=["id"], rule="first")
    source = log.stream(spark, conversation_files(spark, sf))
    run_once(source, "text-writer", root, jobs.text_writer_batch(store, now(), jobs.DeadLetters(f"{root}/dead")))
    return store.read().select("id", F.md5("content").alias("content"), "source")


def embeddings_store(spark, sf, root):
    """An embeddings table that already holds the labelled messages, with an empty text."""
    store = KeyedTable(spark, f"{root}/table", TEXT_EMBEDDINGS, key=["text_message_id"], rule="first")
    known = table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("text_message_id"),
        F.lit("").alias("text_content"),
        F.lit(None).cast("array<float>").alias("embedding"),
        now(BASE).alias("created_at"),
    )
    store.replace(known)
    return store


@plan(f"""
WITH {MESSAGES_SQL}, {EMBEDDED}
SELECT e.id AS text_message_id, md5(CASE WHEN l.doc_id IS NULL THEN content ELSE '' END) AS text_content,
       CASE WHEN l.doc_id IS NULL THEN round(CAST(embedding[1] AS DOUBLE), 5) END AS first_value
FROM embedded e LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON CAST(l.doc_id AS VARCHAR) = e.id""")
def stream_incremental_embed(spark, sf):
    """A message table read as a stream: what has no embedding yet gets one."""

    def write(path):
        messages(spark, sf).write.parquet(path)

    path = staged(spark, sf, "message-table", write)
    root = new_scratch(spark, "incremental")
    store = embeddings_store(spark, sf, root)
    source = spark.readStream.schema(TEXT_MESSAGES).parquet(path)
    run_once(source, "incremental", root, jobs.incremental_embed_batch(store, EMBED, now(), jobs.DeadLetters(f"{root}/dead")))
    return store.read().select(
        "text_message_id",
        F.md5("text_content").alias("text_content"),
        F.round(F.get("embedding", 0).cast("double"), 5).alias("first_value"),
    )


@plan(f"""
WITH {MESSAGES_SQL},
failing AS (SELECT id, content, coalesce(length(content), 0) % 7 = 3 AS fails FROM messages)
SELECT id, CASE WHEN l.doc_id IS NOT NULL THEN 'known' WHEN fails THEN 'failed' ELSE 'embedded' END AS state
FROM failing LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON CAST(l.doc_id AS VARCHAR) = id""")
def stream_embed_failures(spark, sf):
    """A model that fails on some texts: every message is either stored or set aside."""

    def moody(rows):
        fails = F.coalesce(F.length("text"), F.lit(0)) % 7 == 3
        return EMBED(rows).withColumn("embed_error", F.when(fails, F.lit("the model failed")))

    path = staged(spark, sf, "message-table", lambda path: messages(spark, sf).write.parquet(path))
    root = new_scratch(spark, "failures")
    store, dead = embeddings_store(spark, sf, root), jobs.DeadLetters(f"{root}/dead")
    source = spark.readStream.schema(TEXT_MESSAGES).parquet(path)
    run_once(source, "failures", root, jobs.incremental_embed_batch(store, moody, now(), dead))
    known = F.when(F.col("embedding").isNull(), F.lit("known")).otherwise(F.lit("embedded"))
    stored = store.read().select(F.col("text_message_id").alias("id"), known.alias("state"))
    documents = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"))
    return stored.join(documents, "id", "left_semi").unionByName(dead.read(spark).select(F.col("key").alias("id"), F.lit("failed").alias("state")))


@plan(f"""
WITH {MESSAGES_SQL},
pending AS (SELECT id, content FROM messages WHERE id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)
            ORDER BY created_at, id LIMIT 10),
{sql_embed('pending', 'embedded', 'content', DIM)}
SELECT id AS text_message_id, md5(content) AS text_content, (SELECT count(*) FROM pending) AS processed, {FIRST}
FROM embedded""")
def process_pending(spark, sf):
    """One round of the poller over the whole message table: the ten oldest."""
    root = new_scratch(spark, "pending")
    store = embeddings_store(spark, sf, root)
    count = jobs.process_pending(messages(spark, sf), store, EMBED, now(), jobs.DeadLetters(f"{root}/dead"), batch_size=10)
    return store.read().filter("text_content <> ''").select(
        "text_message_id",
        F.md5("text_content").alias("text_content"),
        F.lit(count).cast("bigint").alias("processed"),
        F.round(F.get("embedding", 0).cast("double"), 5).alias("first_value"),
    )


@plan("""
SELECT CASE event_type WHEN 'error' THEN 'malformed_json' WHEN 'signup' THEN 'blank_text' END AS reject_reason,
       count(*) AS messages, count(DISTINCT CASE WHEN event_id % 2 = 0 THEN event_id END) AS keys
FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1""")
def stream_dead_letter(spark, sf):
    """What the embedding job refuses ends up with its reason."""
    path = staged(spark, sf, "event-log", lambda p: log.write_files(event_log(spark, sf), p))
    root = new_scratch(spark, "dead")
    dead = jobs.DeadLetters(f"{root}/dead")
    body = jobs.embed_batch(EMBED, jobs.file_sink(f"{root}/out"), now(), dead)
    run_once(log.stream(spark, path), "dead-letter", root, body)
    return spark.read.parquet(dead.path).groupBy("reject_reason").agg(
        F.count("*").alias("messages"), F.countDistinct("key").alias("keys")
    )


BY_TURN = 1_000_000_000


def _read_from(spark, sf, starting, label):
    """What a job reads of the conversations, turn by turn in one log, when only their turns 0 and 1
    were there at its first start; batches of at most 2,000 messages."""
    root = new_scratch(spark, label)
    turns = log.batch(spark, conversation_files(spark, sf)).withColumn(
        "offset", F.col("offset") % 1000 * BY_TURN + F.floor(F.col("offset") / 1000)
    )
    early = F.col("offset") < 2 * BY_TURN

    def source():
        return log.stream(
            spark, f"{root}/log", topic="text-messages", starting=starting,
            max_per_trigger=2000, per_file=500, checkpoint=f"{root}/checkpoint-{label}",
        )

    log.write_files(turns.filter(early), f"{root}/log", per_file=500)
    source()
    log.write_files(turns.filter(~early), f"{root}/log", per_file=500)
    run_once(source(), label, root, lambda batch, name: batch.write.mode("overwrite").parquet(f"{root}/read/{name}"))
    found = spark.read.schema(LOG).parquet(f"{root}/read/*")
    return found.select("partition", "offset", F.md5(F.get_json_object("value", "$.text")).alias("text"))


TURNS = f"""
SELECT CAST(conv_id % 4 AS INTEGER) AS partition, turn * {BY_TURN} + conv_id AS "offset",
       md5(CASE WHEN role <> 'system' THEN text END) AS text
FROM conversations"""


@plan(f"{TURNS} WHERE turn >= 2")
def stream_from_latest(spark, sf):
    """Only what came after the job's first start."""
    return _read_from(spark, sf, log.LATEST, "from-latest")


@plan(f"{TURNS} WHERE turn >= 3 OR conv_id % 4 = 3")
def stream_from_offsets(spark, sf):
    """Three partitions from their fourth turns, the last from its first message."""
    return _read_from(spark, sf, {"text-messages": {p: 3 * BY_TURN for p in range(3)}}, "from-offsets")
