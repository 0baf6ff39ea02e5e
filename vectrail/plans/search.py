"""Lookups, text search and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.chunk import explode_chunks, word_chunks
from ..functions.embed import embed_hash, embed_query
from ..operators import ann
from ..operators import search as ops
from ..session import new_scratch, spread
from .inputs import BASE, MESSAGES_SQL, messages, now, sql_distance, sql_embed, sql_word_chunks, table
from .registry import plan

DIM = 64
QUERY = "artificial intelligence machine learning"


def chunk_embeddings(spark, sf):
    """Every chunk of every document with its vector."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    chunks = explode_chunks(docs, word_chunks(F.col("text"), 128), "doc_id")
    return chunks.select(
        F.format_string("%09d:%06d", "doc_id", "chunk_index").alias("id"),
        "chunk",
        embed_hash(F.col("chunk"), DIM).alias("embedding"),
    )


CHUNK_EMBEDDINGS_SQL = f"""
plain AS (SELECT doc_id, text AS document FROM documents),
{sql_word_chunks('plain', 128)},
named AS (SELECT printf('%09d:%06d', doc_id, chunk_index) AS id, chunk FROM chunks),
{sql_embed('named', 'embedded', 'chunk', DIM)},
asked AS (SELECT '{QUERY}' AS q),
{sql_embed('asked', 'query', 'q', DIM)}"""


@plan(f"""
WITH RECURSIVE {CHUNK_EMBEDDINGS_SQL}
SELECT id, md5(chunk) AS chunk, round(distance, 6) AS distance
FROM (SELECT id, chunk, {sql_distance('embedded.embedding', 'query.embedding')} AS distance FROM embedded, query)
ORDER BY round(distance, 6), id LIMIT 10""")
def search_corpus(spark, sf):
    """The whole way: chunk, embed, and search every document for one query text."""
    found = ops.top_k(chunk_embeddings(spark, sf), embed_query(spark, QUERY, DIM), 10, "id")
    return found.select("id", F.md5("chunk").alias("chunk"), F.round("distance", 6).alias("distance"))


@plan(f"""
SELECT vec_id, label, round(d, 6) AS distance
FROM (SELECT e.vec_id, e.label, {sql_distance('e.embedding', 'q.embedding')} AS d
      FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q)
ORDER BY round(d, 6), vec_id LIMIT 10""")
def topk_cosine(spark, sf):
    vectors = table(spark, sf, "embeddings")
    query = vectors.orderBy("vec_id").first().embedding
    return ops.top_k(vectors, query, 10, "vec_id").withColumn("distance", F.round("distance", 6))


@plan(f"""
WITH named AS (SELECT doc_id, text FROM documents), {sql_embed('named', 'corpus', 'text', DIM)},
items AS (SELECT item_id, text FROM benchmark), {sql_embed('items', 'asked', 'text', DIM)}
SELECT query_id, doc_id, rank, distance FROM (
  SELECT a.item_id AS query_id, c.doc_id,
         round({sql_distance('a.embedding', 'c.embedding')}, 6) AS distance,
         CAST(row_number() OVER (PARTITION BY a.item_id ORDER BY
           round({sql_distance('a.embedding', 'c.embedding')}, 6), c.doc_id) AS INTEGER) AS rank
  FROM asked a, corpus c)
WHERE rank <= 10""")
def topk_cosine_batch(spark, sf):
    def embedded(name, *keys):
        rows = spread(table(spark, sf, name).select(*keys, "text"), *keys)
        return rows.select(*keys, embed_hash(F.col("text"), DIM).alias("embedding"))

    return ops.top_k_many(
        embedded("benchmark", "item_id"),
        embedded("documents", "doc_id"),
        10,
        query_id="item_id",
        id="doc_id",
    )


# Queries of the index: every hundredth vector.
ASKED_SQL = f"""
WITH ranked AS (
  SELECT q.vec_id AS query_id, e.vec_id, round({sql_distance('q.embedding', 'e.embedding')}, 6) AS distance,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY round({sql_distance('q.embedding', 'e.embedding')}, 6), e.vec_id) AS rank
  FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, distance, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 10"""


def asked(vectors):
    return vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@plan(ASKED_SQL)
def topk_ivf(spark, sf):
    """Every hundredth vector against all rows of the index, all lists probed: exact."""
    vectors = table(spark, sf, "embeddings")
    path = new_scratch(spark, "ivf")
    ann.build_index(vectors, path, "vec_id", lists=20)
    return ann.open_index(spark, path).search_many(asked(vectors), 10, "query_id", probes=20)


@plan(ASKED_SQL)
def topk_ivf_added(spark, sf):
    """An index of one label's vectors that the others are added to, batch by batch, and whose crowded lists split."""
    vectors = table(spark, sf, "embeddings")
    path = new_scratch(spark, "ivf-added")
    ann.build_index(vectors.filter("label % 4 = 0"), path, "vec_id", lists=20)
    for k in (1, 2, 3):
        batch = vectors.filter(F.coalesce(F.pmod("label", F.lit(4)), F.lit(3)) == k)
        ann.open_index(spark, path).add(batch, f"batch {k}")
    index = ann.open_index(spark, path).split_crowded(factor=1.5)
    return index.search_many(asked(vectors), 10, "query_id", probes=len(index.list_ids))


@plan(f"""
WITH {MESSAGES_SQL}
SELECT id, md5(content) AS content, processed_at FROM messages
WHERE content ILIKE '%THE%on_%' ORDER BY processed_at DESC, id LIMIT 10""")
def search_text(spark, sf):
    found = ops.search_text(messages(spark, sf), "THE%on_", "content", "processed_at", "id", 10)
    return found.select(
        "id", F.md5("content").alias("content"), F.unix_seconds("processed_at").alias("processed_at")
    )


@plan(f"WITH {MESSAGES_SQL} SELECT id, md5(content) AS content, source, created_at FROM messages WHERE id = '77'")
def get_by_id(spark, sf):
    return ops.get_by_id(messages(spark, sf), "77").select(
        "id", F.md5("content").alias("content"), "source", F.unix_seconds("created_at").alias("created_at")
    )


@plan(f"WITH {MESSAGES_SQL} SELECT id, processed_at FROM messages WHERE processed_at > {BASE + 5400 - 3600}")
def recent_1h(spark, sf):
    return ops.recent(messages(spark, sf), now(), "1 hour").select(
        "id", F.unix_seconds("processed_at").alias("processed_at")
    )


@plan(f"""
WITH {MESSAGES_SQL} SELECT id, processed_at, md5(content) AS message FROM messages
WHERE processed_at > {BASE + 87600 - 86400}""")
def recent_24h(spark, sf):
    found = ops.recent(messages(spark, sf), now(BASE + 87600), "24 hours")
    return found.select(
        "id",
        F.unix_seconds("processed_at").alias("processed_at"),
        F.md5("content").alias("message"),
    )


@plan(f"WITH {MESSAGES_SQL} SELECT id, created_at FROM messages ORDER BY created_at DESC, id LIMIT 25")
def read_latest(spark, sf):
    return ops.newest(messages(spark, sf), "created_at", "id", 25).select(
        "id", F.unix_seconds("created_at").alias("created_at")
    )


@plan(f"""
WITH {MESSAGES_SQL}
SELECT id, processed_at, (SELECT count(*) FROM messages) AS total FROM messages
ORDER BY processed_at DESC, id LIMIT 50 OFFSET 20""")
def paginate_messages(spark, sf):
    page, total = ops.paginate(messages(spark, sf), "processed_at", "id", 50, 20)
    return page.select(
        "id", F.unix_seconds("processed_at").alias("processed_at"), F.lit(total).cast("bigint").alias("total")
    )


@plan(f"""
WITH {MESSAGES_SQL}
SELECT id, created_at, CAST(0.5 AS DOUBLE) AS distance FROM messages ORDER BY created_at DESC, id LIMIT 10""")
def search_recent(spark, sf):
    return ops.search_recent(messages(spark, sf), "created_at", "id").select(
        "id", F.unix_seconds("created_at").alias("created_at"), "distance"
    )


@plan(f"""
WITH ranked AS (
  SELECT q.vec_id AS query_id, e.vec_id, round({sql_distance('q.embedding', 'e.embedding')}, 6) AS distance,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY round({sql_distance('q.embedding', 'e.embedding')}, 6), e.vec_id) AS rank
  FROM embeddings q, embeddings e WHERE q.vec_id % 300 = 0)
SELECT query_id, vec_id, distance, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 10""")
def topk_cosine_batch_ragged(spark, sf):
    """Every hundredth vector, of three one without a vector and one too short, in several blocks: only whole ones have neighbours."""
    vectors = table(spark, sf, "embeddings")
    place = F.col("vec_id") % 300
    queries = vectors.filter("vec_id % 100 = 0").select(
        F.col("vec_id").alias("query_id"),
        F.when(place == 100, F.lit(None)).when(place == 200, F.slice("embedding", 1, 5)).otherwise(F.col("embedding")).alias("embedding"),
    )
    found = ops.top_k_many(queries, vectors, 10, "query_id", "vec_id", block_bytes=64 * 8 * DIM)
    return found.select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")
