"""Keyed writes, adaptive access, reconciliation and the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, keyed, registry
from ..operators.tables import KeyedTable, routed_table
from ..schemas import EMBEDDINGS, TEXT_MESSAGES
from ..session import new_scratch
from .inputs import BASE, MESSAGES_SQL, done_embeddings, messages, now, table
from .registry import plan


def turns(spark, sf):
    """Conversations as a message log: repeated keys, ordered by turn."""
    return table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("id"), "turn", "role", "text"
    )


@plan("""
SELECT CAST(conv_id AS VARCHAR) AS id, arg_max(role, turn) AS role, md5(arg_max(text, turn)) AS text
FROM conversations GROUP BY conv_id""")
def upsert_last_wins(spark, sf):
    """Two batches into a keyed table, the later one overwriting."""
    rows = turns(spark, sf).withColumn("source", F.col("role")).select(
        "id", "text", F.lit(None).cast("array<float>").alias("embedding"),
        F.timestamp_seconds(F.lit(BASE) + F.col("turn")).alias("timestamp"),
        "source", F.lit("{}").alias("metadata"), "turn",
    )
    store = KeyedTable(spark, new_scratch(spark, "upsert"), EMBEDDINGS, key=["id"])
    store.append(rows.filter("turn < 3"), 0, order=["turn"])
    store.compact()
    store.append(rows.filter("turn >= 3"), 1, order=["turn"])
    return store.read().select("id", F.col("source").alias("role"), F.md5("text").alias("text"))


@plan("""
SELECT CAST(conv_id AS VARCHAR) AS id, arg_min(role, turn) AS source, md5(arg_min(text, turn)) AS content
FROM conversations GROUP BY conv_id""")
def insert_if_absent(spark, sf):
    rows = turns(spark, sf).select(
        "id", F.col("text").alias("content"), F.col("role").alias("source"),
        now().alias("created_at"), now().alias("processed_at"), "turn",
    )
    store = KeyedTable(spark, new_scratch(spark, "insert"), TEXT_MESSAGES, key=["id"], rule="first")
    store.append(rows.filter("turn < 2"), 0, order=["turn"])
    store.append(rows, 1, order=["turn"])
    return store.read().select("id", "source", F.md5("content").alias("content"))


@plan(f"""
SELECT CAST(conv_id AS VARCHAR) AS id, md5(arg_max(text, turn)) AS text,
       {BASE} + min(turn) AS created_at, {BASE} + max(turn) AS updated_at
FROM conversations GROUP BY conv_id""")
def upsert_touch_updated_at(spark, sf):
    written = F.timestamp_seconds(F.lit(BASE) + F.col("turn"))
    rows = turns(spark, sf).select(
        "id", "text", "turn", written.alias("created_at"), written.alias("updated_at")
    )
    rows = rows.withColumn("embedding", F.lit(None).cast("array<float>"))
    shape = rows.drop("turn").schema
    store = KeyedTable(spark, new_scratch(spark, "touch"), shape, key=["id"], keep_first=["created_at"])
    store.append(rows.filter("turn < 3"), 0, order=["turn"])
    store.compact()
    store.append(rows.filter("turn >= 3"), 1, order=["turn"])
    return store.read().select(
        "id",
        F.md5("text").alias("text"),
        F.unix_seconds("created_at").alias("created_at"),
        F.unix_seconds("updated_at").alias("updated_at"),
    )


@plan("""
SELECT CASE WHEN role = 'system' THEN 'embeddings' ELSE role END AS table_name,
       CAST(conv_id AS VARCHAR) AS id, md5(arg_max(text, turn)) AS text
FROM conversations GROUP BY ALL""")
def route_by_table(spark, sf):
    destination = F.when(F.col("role") != "system", F.col("role")).otherwise("embeddings")
    rows = turns(spark, sf).select(
        "id", "text", F.lit(None).cast("array<float>").alias("embedding"), now().alias("timestamp"),
        F.lit("unknown").alias("source"), F.lit("{}").alias("metadata"),
        destination.alias("table_name"), "turn",
    )
    store = routed_table(spark, new_scratch(spark, "routed"), EMBEDDINGS)
    store.append(rows, 0, order=["turn"])
    return store.read().select("table_name", "id", F.md5("text").alias("text"))


@plan("""
SELECT CAST(vec_id AS VARCHAR) AS message_id, 'vector ' || vec_id AS original_text,
       CASE WHEN label = 3 THEN 'unknown' ELSE 'm' || label END AS model_name FROM embeddings
UNION ALL
SELECT 'managed ' || vec_id, 'vector ' || vec_id, 'm' || label FROM embeddings""")
def adaptive_read(spark, sf):
    """Both table shapes through the same reader."""
    vectors = table(spark, sf, "embeddings")
    id, text = F.col("vec_id").cast("string"), F.concat(F.lit("vector "), F.col("vec_id"))
    model = F.concat(F.lit("m"), F.col("label"))
    writer = vectors.select(
        id.alias("id"), text.alias("text"), "embedding", now().alias("timestamp"),
        F.when(F.col("label") != 3, model).alias("source"), F.lit("{}").alias("metadata"),
    )
    managed = vectors.select(
        F.concat(F.lit("managed "), id).alias("message_id"), text.alias("original_text"), "embedding",
        model.alias("model_name"), now().alias("created_at"), now().alias("updated_at"),
    )
    both = keyed.adaptive_read(writer).unionByName(keyed.adaptive_read(managed))
    return both.select("message_id", "original_text", "model_name")


@plan("""
SELECT CAST(vec_id AS VARCHAR) AS id, 80 AS dimension, CASE WHEN label = 3 THEN 'cli' ELSE 'm' || label END AS source,
       round(CAST(embedding[1] AS DOUBLE), 5) AS first_value
FROM embeddings WHERE label <> 4""")
def adaptive_insert(spark, sf):
    vectors = table(spark, sf, "embeddings")
    rows = vectors.select(
        F.col("vec_id").cast("string").alias("id"),
        F.when(F.col("label") != 4, F.concat(F.lit("vector "), F.col("vec_id"))).alias("text"),
        "embedding",
        F.when(F.col("label") != 3, F.concat(F.lit("m"), F.col("label"))).alias("source"),
        F.lit(None).cast("timestamp").alias("timestamp"),
        F.lit(None).cast("string").alias("metadata"),
    )
    return keyed.adaptive_rows(rows, EMBEDDINGS.fieldNames(), 80, now()).select(
        "id",
        F.size("embedding").alias("dimension"),
        "source",
        F.round(F.get("embedding", 0).cast("double"), 5).alias("first_value"),
    )


# --- reconciliation --------------------------------------------------------------------
@plan(f"""
WITH {MESSAGES_SQL}
SELECT id, created_at FROM messages m
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE CAST(l.doc_id AS VARCHAR) = m.id)
ORDER BY created_at, id LIMIT 10""")
def unprocessed_batch(spark, sf):
    pending = joins.unprocessed(messages(spark, sf), done_embeddings(spark, sf), 10)
    return pending.select("id", F.unix_seconds("created_at").alias("created_at"))


@plan(f"""
WITH {MESSAGES_SQL}
SELECT id FROM messages m WHERE created_at > {BASE + 50}
AND NOT EXISTS (SELECT 1 FROM labels l WHERE CAST(l.doc_id AS VARCHAR) = m.id)""")
def unprocessed_after(spark, sf):
    return joins.unprocessed(
        messages(spark, sf), done_embeddings(spark, sf), after=now(BASE + 50)
    ).select("id")


@plan("""
SELECT d.doc_id AS id, l.doc_id IS NOT NULL AS persisted
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""")
def reconcile_persisted(spark, sf):
    produced = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    persisted = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return joins.reconcile(produced, {"persisted": persisted})


@plan("""
SELECT d.doc_id AS id, bool_or(coalesce(l.doc_id IS NOT NULL, false)) AS embedded,
       bool_or(coalesce(l.quality = 1, false)) AS persisted
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.doc_id""")
def reconcile_stages(spark, sf):
    produced = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "id")
    return joins.reconcile(produced, {"embedded": labels, "persisted": labels.filter("quality = 1")})


@plan("""
SELECT CAST(vec_id AS VARCHAR) AS text_message_id FROM embeddings
WHERE vec_id NOT IN (SELECT doc_id FROM labels)""")
def orphan_embeddings(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("text_message_id"))
    known = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"))
    return joins.orphans(vectors, known)


# --- registry ----------------------------------------------------------------------------
def catalog_of(spark, sf, label, kind):
    """A catalog whose entries are read off the data: one table per document source."""
    catalog = registry.Catalog(spark, new_scratch(spark, label))
    tables = table(spark, sf, "documents").groupBy(F.col("source").alias("table_name")).agg(
        F.concat(F.lit("documents in "), F.min("lang")).alias("description"),
        F.lit(384).alias("vector_dimension"),
        F.lit(registry.DEFAULT_MODEL).alias("model_name"),
        F.lit(kind).alias("kind"),
    )
    catalog.create_all(tables, now())
    return catalog


@plan(f"""
SELECT source AS table_name, 'documents in ' || min(lang) AS description, 384 AS vector_dimension,
       '{registry.DEFAULT_MODEL}' AS model_name FROM documents GROUP BY source ORDER BY source""")
def list_tables(spark, sf):
    return catalog_of(spark, sf, "list", "managed").list().drop("created_at")


def given_vectors(spark, sf):
    """Vectors as records to insert: some without a text, some cut short."""
    id = F.col("vec_id").cast("string")
    cut = F.when(F.col("vec_id") % 5 == 1, F.slice("embedding", 1, 60)).otherwise(F.col("embedding"))
    return table(spark, sf, "embeddings").select(
        id.alias("id"),
        F.when(F.col("vec_id") % 7 != 2, F.concat(F.lit("vector "), id)).alias("text"),
        cut.alias("embedding"),
        F.when(F.col("vec_id") % 3 != 0, F.concat(F.lit("m"), F.col("label"))).alias("source"),
        F.lit(None).cast("timestamp").alias("timestamp"),
        F.lit(None).cast("string").alias("metadata"),
    )


@plan("""
WITH languages AS (SELECT 'documents in ' || lang AS table_name, count(*) FILTER (text <> '') AS row_count,
                          min(CAST(doc_id AS VARCHAR)) FILTER (text <> '') AS sample_id
                   FROM documents WHERE lang IS NOT NULL GROUP BY lang)
SELECT table_name, 64 AS vector_dimension, row_count, sample_id FROM languages
UNION ALL SELECT 'nothing yet', 64, 0, NULL""")
def table_info(spark, sf):
    """Dimension, rows and a sample of every table of a catalog: one per language, and one that is empty."""
    catalog = registry.Catalog(spark, new_scratch(spark, "info"))
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"), "lang",
        F.lit(None).cast("array<float>").alias("embedding"), "source",
        F.lit(None).cast("timestamp").alias("timestamp"), F.lit(None).cast("string").alias("metadata"),
    )
    languages = sorted(r.lang for r in docs.filter("lang is not null").select("lang").distinct().collect())
    named = spark.createDataFrame([(f"documents in {x}",) for x in languages] + [("nothing yet",)], "table_name string")
    catalog.create_all(named.select("table_name", F.lit("").alias("description"), F.lit(64).alias("vector_dimension"),
                                    F.lit(registry.DEFAULT_MODEL).alias("model_name"), F.lit("writer").alias("kind")), now())
    for lang in languages:
        catalog.insert(f"documents in {lang}", docs.filter(F.col("lang") == lang), now())
    return catalog.describe().select("table_name", "vector_dimension", "row_count", "sample_id")


@plan("""
WITH given AS (
  SELECT vec_id, CAST(vec_id AS VARCHAR) AS id, vec_id % 7 <> 2 AS has_text, vec_id % 5 = 1 AS short,
         CASE WHEN vec_id % 3 <> 0 THEN 'm' || label ELSE 'cli' END AS source, embedding
  FROM embeddings)
SELECT 'managed' AS kind, id, source, 64 AS dimension, round(CAST(embedding[64] AS DOUBLE), 5) AS last_value, NULL AS reject_reason
FROM given WHERE has_text AND NOT short
UNION ALL SELECT 'managed', id, source, CASE WHEN short THEN 60 ELSE 64 END, NULL,
  CASE WHEN has_text THEN 'wrong_dimension' ELSE 'missing_text' END FROM given WHERE short OR NOT has_text
UNION ALL SELECT 'writer', id, source, 64, CASE WHEN short THEN 0.0 ELSE round(CAST(embedding[64] AS DOUBLE), 5) END, NULL
FROM given WHERE has_text
UNION ALL SELECT 'writer', id, source, CASE WHEN short THEN 60 ELSE 64 END, NULL, 'missing_text' FROM given WHERE NOT has_text""")
def catalog_insert(spark, sf):
    """The same records into a table of each kind: a managed one refuses short vectors, a writer's pads them."""
    catalog, given = registry.Catalog(spark, new_scratch(spark, "catalog")), given_vectors(spark, sf)
    parts = []
    for kind, id, source in (("managed", "message_id", "model_name"), ("writer", "id", "source")):
        catalog.create(f"{kind} vectors", 64, kind=kind, now=now())
        refused = catalog.insert(f"{kind} vectors", given, now())
        kept = catalog.table(f"{kind} vectors").read()
        parts.append(kept.select(
            F.lit(kind).alias("kind"), F.col(id).alias("id"), F.col(source).alias("source"), F.size("embedding").alias("dimension"),
            F.round(F.get("embedding", 63).cast("double"), 5).alias("last_value"), F.lit(None).cast("string").alias("reject_reason"),
        ))
        parts.append(refused.select(
            F.lit(kind).alias("kind"), "id", F.coalesce("source", F.lit("cli")).alias("source"), F.size("embedding").alias("dimension"),
            F.lit(None).cast("double").alias("last_value"), "reject_reason",
        ))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
