"""Messages, logs and rejects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import messages as m
from ..functions.chunk import chunk_id, explode_chunks, word_chunks
from ..session import spread
from ..sources import log
from .inputs import BASE, NOW, now, sql_word_chunks, staged, table
from .registry import plan


def chunk_messages(spark, sf):
    """Every chunk of every document as a text message."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id")
    chunks = explode_chunks(docs, word_chunks(F.col("text"), 128), "doc_id", "source")
    value = m.envelope(
        id=chunk_id(F.col("doc_id"), F.col("chunk_index")),
        text=F.col("chunk"),
        timestamp=(F.lit(BASE) + F.col("doc_id")).cast("double"),
        source=F.concat(F.lit("ingestion-"), F.col("source")),
        model=F.when(F.col("doc_id") % 2 == 0, "small"),
        experiment_config=F.struct(
            F.lit("cc_news").alias("dataset"),
            F.lit(0.5).alias("chunk_size_kb"),
            F.lit(128).alias("chunk_size_tokens"),
            F.lit(False).alias("burst_enabled"),
        ),
    )
    return chunks.select(
        chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("key"),
        value.alias("value"),
    )


@plan(f"""
WITH RECURSIVE plain AS (SELECT doc_id, text AS document FROM documents), {sql_word_chunks('plain', 128)}
SELECT md5(c.doc_id || ':' || chunk_index) AS key, md5(c.doc_id || ':' || chunk_index) AS id,
       md5(chunk) AS text, CAST({BASE} + c.doc_id AS DOUBLE) AS timestamp, 'ingestion-' || d.source AS source,
       CASE WHEN c.doc_id % 2 = 0 THEN 'small' END AS model, 'cc_news' AS dataset, 128 AS chunk_size_tokens
FROM chunks c JOIN documents d ON d.doc_id = c.doc_id""")
def message_envelope(spark, sf):
    """Build the JSON and read it back field by field."""
    v = F.col("v")
    return chunk_messages(spark, sf).select("key", F.parse_json("value").alias("v")).select(
        "key",
        F.variant_get(v, "$.id", "string").alias("id"),
        F.md5(F.variant_get(v, "$.text", "string")).alias("text"),
        F.variant_get(v, "$.timestamp", "double").alias("timestamp"),
        F.variant_get(v, "$.source", "string").alias("source"),
        F.variant_get(v, "$.model", "string").alias("model"),
        F.variant_get(v, "$.experiment_config.dataset", "string").alias("dataset"),
        F.variant_get(v, "$.experiment_config.chunk_size_tokens", "int").alias("chunk_size_tokens"),
    )


def event_log(spark, sf):
    """Events as a log whose values take every shape a message can have:

    click: a full object; view: no id; purchase: a bare JSON string; signup: blank text;
    error: cut off in the middle.
    """
    kind, id = F.col("event_type"), F.concat(F.lit("e"), F.col("event_id"))
    full = m.envelope(
        id=id,
        text=F.concat(F.lit("user "), F.col("user_id")),
        timestamp=F.col("value"),
        source=kind,
        model=F.lit(""),
    )
    anonymous = F.to_json(F.struct(F.concat(F.lit("user "), F.col("user_id")).alias("text")))
    blank = F.to_json(F.struct(id.alias("id"), F.lit(" \t").alias("text")))
    value = (
        F.when(kind == "click", full)
        .when(kind == "view", anonymous)
        .when(kind == "purchase", F.concat(F.lit('"bought by '), F.col("user_id"), F.lit('"')))
        .when(kind == "signup", blank)
        .otherwise(F.lit('{"id": "e", "text": "cut o'))
    )
    events = spread(table(spark, sf, "events"), "event_id")
    return log.to_log(
        events,
        key=F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("k"), F.col("event_id"))),
        value=value,
        topic="text-messages",
        offset=F.col("event_id"),
        timestamp=F.lit(None).cast("timestamp"),
        partition=F.col("user_id") % 4,
    )


@plan("""
SELECT event_id AS "offset", event_type <> 'error' AS is_json,
       CASE WHEN event_type = 'error' THEN NULL
            WHEN event_type IN ('click', 'signup') THEN 'e' || event_id
            WHEN event_id % 2 = 0 THEN 'k' || event_id ELSE 'unknown' END AS id,
       CASE event_type WHEN 'click' THEN 'user ' || user_id WHEN 'view' THEN 'user ' || user_id
            WHEN 'purchase' THEN 'bought by ' || user_id WHEN 'signup' THEN ' ' || chr(9) END AS text,
       CASE WHEN event_type = 'click' THEN round(value, 6) END AS input_timestamp,
       CASE WHEN event_type = 'click' THEN 'click' END AS input_source
FROM events""")
def parse_message(spark, sf):
    return m.parse_text_messages(event_log(spark, sf)).select(
        "offset",
        "is_json",
        "id",
        "text",
        F.round("input_timestamp", 6).alias("input_timestamp"),
        "input_source",
    )


@plan("""
SELECT event_id AS "offset" FROM events WHERE event_type IN ('click', 'signup')""")
def require_fields(spark, sf):
    parsed = m.parse_text_messages(event_log(spark, sf))
    return m.good(m.with_reject_reason(parsed, m.required_field_checks())).select("offset")


@plan("""
SELECT reason AS reject_reason, count(*) AS messages, min(event_id) AS first_offset
FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 'malformed_json' WHEN 'signup' THEN 'blank_text' END AS reason
      FROM events) WHERE reason IS NOT NULL GROUP BY reason""")
def dead_letter(spark, sf):
    parsed = m.parse_text_messages(event_log(spark, sf))
    refused = m.rejected(m.with_reject_reason(parsed, m.text_message_checks()))
    return refused.groupBy("reject_reason").agg(
        F.count("*").alias("messages"), F.min("offset").alias("first_offset")
    )


def fallback_log(spark, sf):
    """Embedding messages with one field or another empty, zero or absent."""
    kind = F.col("event_type")
    number = F.lit(float(BASE)) + F.col("event_id")
    iso = F.date_format(F.timestamp_seconds(F.lit(BASE) + F.col("event_id")), "yyyy-MM-dd'T'HH:mm:ss")
    common = [
        F.when(kind == "view", "").when(kind != "error", F.concat(F.lit("e"), F.col("event_id"))).alias("id"),
        F.when(kind == "signup", F.concat(F.lit("text "), F.col("user_id"))).alias("text"),
        F.concat(F.lit("original "), F.col("user_id")).alias("original_text"),
        F.when(kind == "click", "").otherwise(kind).alias("model_name"),
        F.when(kind == "click", "input").alias("input_source"),
        F.when(kind == "purchase", F.lit(0.0)).alias("zero"),
        F.when(kind == "purchase", "audit").alias("table_name"),
    ]
    def message(timestamp, processing):
        return F.to_json(F.struct(*common, timestamp.alias("timestamp"), processing.alias("processing_timestamp")))

    none = F.lit(None).cast("string")
    value = (
        F.when(kind == "click", message(number, none))
        .when(kind == "view", message(F.concat(iso, F.lit("Z")), none))
        .when(kind == "signup", message(F.concat(iso, F.lit("+02:00")), none))
        .when(kind == "purchase", message(F.lit(0), number))
        .otherwise(message(F.lit("soon"), number))
    )
    return log.to_log(
        spread(table(spark, sf, "events"), "event_id"),
        key=F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("k"), F.col("event_id"))).otherwise(""),
        value=value, topic="embeddings", offset=F.col("event_id"),
        timestamp=F.lit(None).cast("timestamp"), partition=F.col("user_id") % 4,
    )


@plan(f"""
SELECT event_id AS "offset",
       CASE WHEN event_type IN ('view', 'error') THEN CASE WHEN user_id % 2 = 0 THEN 'k' || event_id ELSE 'unknown' END
            ELSE 'e' || event_id END AS id,
       CASE WHEN event_type = 'signup' THEN 'text ' ELSE 'original ' END || user_id AS text,
       CASE WHEN event_type = 'click' THEN 'input' ELSE event_type END AS source,
       CASE event_type WHEN 'signup' THEN {BASE} + event_id - 7200 WHEN 'error' THEN {NOW}
            ELSE {BASE} + event_id END AS timestamp,
       CASE WHEN event_type = 'purchase' THEN 'audit' ELSE 'embeddings' END AS table_name,
       '{{}}' AS metadata
FROM events""")
def normalize_embedding_message(spark, sf):
    return m.normalize_embedding_messages(fallback_log(spark, sf), now()).select(
        "offset", "id", "text", "source", F.unix_seconds("timestamp").alias("timestamp"),
        "table_name", "metadata",
    )


@plan(f"""
SELECT event_id, CASE event_type WHEN 'click' THEN CAST(floor(value * 1000) AS BIGINT)
       WHEN 'view' THEN {BASE} + event_id WHEN 'signup' THEN {BASE} + event_id - 19800
       WHEN 'purchase' THEN {BASE} + (event_id % 20) * 86400 ELSE {NOW} END AS at
FROM events""")
def normalize_timestamp(spark, sf):
    """Numbers, zoned, naive and date-only text, and junk."""
    kind, seconds = F.col("event_type"), F.lit(BASE) + F.col("event_id")
    iso = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss")
    day = F.date_format(F.timestamp_seconds(F.lit(BASE) + (F.col("event_id") % 20) * 86400), "yyyy-MM-dd")

    def json(value):
        return F.to_json(F.struct(value.alias("t")))

    value = (
        F.when(kind == "click", json(F.floor(F.col("value") * 1000)))
        .when(kind == "view", json(iso))
        .when(kind == "signup", json(F.concat(iso, F.lit("+05:30"))))
        .when(kind == "purchase", json(day))
        .otherwise(json(F.concat(F.lit("later "), iso)))
    )
    events = spread(table(spark, sf, "events"), "event_id").select("event_id", m.parsed(value).alias("v"))
    return events.select(
        "event_id", F.unix_seconds(m.normalize_timestamp(F.col("v"), "$.t", now())).alias("at")
    )


@plan(f"""
SELECT vec_id, 'v' || vec_id AS id, 'text ' || label AS original_text, CAST(len(embedding) AS INTEGER) AS embedding_dimension,
       'm' AS model_name, CAST({NOW} AS DOUBLE) AS processing_timestamp,
       CASE WHEN label > 0 THEN CAST(label AS DOUBLE) END AS input_timestamp,
       CASE WHEN label % 2 = 1 THEN 'src' END AS input_source,
       round(CAST(embedding[1] AS DOUBLE), 5) AS first_value
FROM embeddings""")
def embedding_output(spark, sf):
    """Absent inputs are absent from the JSON, too."""
    rows = table(spark, sf, "embeddings").select(
        "vec_id",
        F.concat(F.lit("v"), F.col("vec_id")).alias("id"),
        F.concat(F.lit("text "), F.col("label")).alias("text"),
        "embedding",
        F.lit("m").alias("model_name"),
        F.col("label").cast("double").alias("input_timestamp"),
        F.when(F.col("label") % 2 == 1, "src").otherwise("").alias("input_source"),
    )
    v = F.col("v")
    return rows.select("vec_id", F.parse_json(m.embedding_output(now())).alias("v")).select(
        "vec_id",
        F.variant_get(v, "$.id", "string").alias("id"),
        F.variant_get(v, "$.original_text", "string").alias("original_text"),
        F.variant_get(v, "$.embedding_dimension", "int").alias("embedding_dimension"),
        F.variant_get(v, "$.model_name", "string").alias("model_name"),
        F.variant_get(v, "$.processing_timestamp", "double").alias("processing_timestamp"),
        F.variant_get(v, "$.input_timestamp", "double").alias("input_timestamp"),
        F.variant_get(v, "$.input_source", "string").alias("input_source"),
        F.round(F.variant_get(v, "$.embedding[0]", "float").cast("double"), 5).alias("first_value"),
    )


def conversation_log(spark, sf):
    turns = table(spark, sf, "conversations")
    value = m.envelope(
        id=F.col("conv_id").cast("string"),
        text=F.when(F.col("role") != "system", F.col("text")),
        timestamp=(F.lit(BASE) + F.col("turn")).cast("double"),
        source=F.col("role"),
    )
    return log.to_log(
        turns,
        key=F.col("conv_id").cast("string"),
        value=value,
        topic="text-messages",
        offset=F.col("conv_id") * 1000 + F.col("turn"),
        timestamp=F.timestamp_seconds(F.lit(BASE) + F.col("turn")),
        partition=F.col("conv_id") % 4,
    )


def conversation_files(spark, sf) -> str:
    """The conversation log as files, written once."""
    return staged(
        spark, sf, "conversation-log", lambda path: log.write_files(conversation_log(spark, sf), path)
    )


@plan(f"""
SELECT CAST(conv_id % 4 AS INTEGER) AS partition, conv_id * 1000 + turn AS "offset", CAST(conv_id AS VARCHAR) AS key,
       CAST(conv_id AS VARCHAR) AS id, md5(CASE WHEN role <> 'system' THEN text END) AS text,
       CAST({BASE} + turn AS DOUBLE) AS message_timestamp, role AS source
FROM conversations ORDER BY conv_id % 4, conv_id * 1000 + turn LIMIT 50""")
def log_read_bounded(spark, sf):
    found = log.read_bounded(log.batch(spark, conversation_files(spark, sf), topic="text-messages"), 50)
    return found.withColumn("text", F.md5("text")).drop("value", "timestamp")

