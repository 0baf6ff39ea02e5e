"""Vector arithmetic and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vector as v
from ..functions.embed import embed_by_model as by_model
from ..functions.embed import embed_hash as hashed
from ..functions.embed import embed_counts, hash_encoder, model_udf, with_model
from ..session import spread
from .inputs import sql_embed, table
from .registry import plan

DIM = 64


def per_component(df, *keys):
    """One row per component, as nested values do not compare well across engines."""
    return df.select(*keys, F.posexplode("embedding").alias("pos", "x")).select(
        *keys, "pos", F.round(F.col("x").cast("double"), 5).alias("x")
    )


def sql_per_component(source: str, *keys: str) -> str:
    names = ", ".join(keys)
    return f"""SELECT {names}, CAST(pos - 1 AS INTEGER) AS pos, round(CAST(x AS DOUBLE), 5) AS x
FROM (SELECT {names}, unnest(range(1, len(embedding) + 1)) AS pos, unnest(embedding) AS x FROM {source})"""


@plan("""
WITH r AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(round(x * 1024) AS INTEGER)) AS q FROM embeddings)
SELECT vec_id, '[' || array_to_string(q, ',') || ']' AS literal, CAST(len(q) AS INTEGER) AS decoded_size,
       CAST(q[7] AS DOUBLE) AS seventh
FROM r""")
def vector_literal(spark, sf):
    whole = F.transform("embedding", lambda x: F.round(x * 1024).cast("int"))
    coded = table(spark, sf, "embeddings").select("vec_id", v.encode_literal(whole).alias("literal"))
    decoded = v.decode_literal(F.col("literal"))
    return coded.select(
        "vec_id",
        "literal",
        F.size(decoded).alias("decoded_size"),
        F.get(decoded, 6).cast("double").alias("seventh"),
    )


@plan(f"""
WITH fitted AS (
  SELECT vec_id, list_resize(list_slice(embedding, 1, 32 + vec_id % 64), 80, CAST(0 AS FLOAT)) AS embedding
  FROM embeddings)
{sql_per_component('fitted', 'vec_id')}""")
def fit_dimension(spark, sf):
    ragged = F.slice("embedding", F.lit(1), (F.lit(32) + F.col("vec_id") % 64).cast("int"))
    return per_component(
        table(spark, sf, "embeddings").select("vec_id", v.fit_dimension(ragged, 80).alias("embedding")),
        "vec_id",
    )


@plan(f"""
WITH scaled AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x * (label % 3) AS DOUBLE)) AS e FROM embeddings),
normed AS (
  SELECT vec_id, list_transform(e, lambda x: CAST(CASE WHEN n > 0 THEN x / n ELSE x END AS FLOAT)) AS embedding
  FROM (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM scaled))
{sql_per_component('normed', 'vec_id')}""")
def l2_normalize(spark, sf):
    scaled = F.transform("embedding", lambda x: x * (F.col("label") % 3))
    return per_component(
        table(spark, sf, "embeddings").select("vec_id", v.l2_normalize(scaled).alias("embedding")),
        "vec_id",
    )


@plan("""
SELECT vec_id, array_to_string(list_transform(embedding[1:5], lambda x: CAST(round(x * 1000) AS INTEGER)), ',') AS head
FROM embeddings""")
def vector_preview(spark, sf):
    head = F.transform(v.preview_vector(F.col("embedding")), lambda x: F.round(x * 1000).cast("int"))
    return table(spark, sf, "embeddings").select(
        "vec_id", F.array_join(head.cast("array<string>"), ",").alias("head")
    )


@plan("""
SELECT vec_id, label, len(embedding) - label % 2 = 64 AS fits FROM embeddings""")
def dimension_check(spark, sf):
    cut = F.when(F.col("label") % 2 == 0, F.col("embedding")).otherwise(F.slice("embedding", 1, 63))
    return table(spark, sf, "embeddings").select(
        "vec_id", "label", v.has_dimension(cut, 64).alias("fits")
    )


@plan(f"WITH {sql_embed('documents', 'embedded', 'text', DIM)} {sql_per_component('embedded', 'doc_id')}")
def embed_hash(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return per_component(docs.select("doc_id", hashed(F.col("text"), DIM).alias("embedding")), "doc_id")


@plan(f"WITH {sql_embed('documents', 'embedded', 'text', DIM)} {sql_per_component('embedded', 'doc_id')}")
def embed_model(spark, sf):
    """The plug-in path: an encoder loaded in the workers, fed Arrow batches of text."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    encode = model_udf(lambda: hash_encoder(DIM))
    return per_component(docs.select("doc_id", encode("text").getField("embedding").alias("embedding")), "doc_id")


def failing_encoder():
    """An encoder that refuses texts of some lengths, and with them the batch they are in."""
    encode = hash_encoder(DIM)

    def run(texts):
        for text in texts:
            if len(text) % 7 == 3:
                raise ValueError(f"{len(text)} characters")
        return encode(texts)

    return run


FAILING_SQL = f"""
given AS (SELECT doc_id, lang, CASE WHEN doc_id % 10 <> 0 THEN text END AS text FROM documents),
judged AS (SELECT *, coalesce(length(text) % 7 = 3, false) AS fails FROM given)"""


def failing_documents(spark, sf):
    """Documents, some without a text, through a model that fails on some."""
    text = F.when(F.col("doc_id") % 10 != 0, F.col("text")).alias("text")
    return with_model(spread(table(spark, sf, "documents").select("doc_id", "lang", text), "doc_id"), failing_encoder)


@plan(f"""
WITH {FAILING_SQL}, fine AS (SELECT doc_id, text FROM judged WHERE text IS NOT NULL AND NOT fails),
{sql_embed('fine', 'embedded', 'text', DIM)}
SELECT j.doc_id, CASE WHEN fails THEN length(j.text) || ' characters' END AS embed_error,
       round(CAST(embedding[1] AS DOUBLE), 5) AS first_value
FROM judged j LEFT JOIN embedded e ON e.doc_id = j.doc_id""")
def embed_model_errors(spark, sf):
    """A failing text has its error; the rest of its batch has vectors."""
    first = F.round(F.get("embedding", 0).cast("double"), 5).alias("first_value")
    return failing_documents(spark, sf).select("doc_id", "embed_error", first)


@plan(f"""
WITH {FAILING_SQL}
SELECT lang, count(*) FILTER (text IS NOT NULL AND NOT fails) AS embedded, count(*) FILTER (fails) AS failed,
       count(*) FILTER (text IS NULL) AS without_text FROM judged GROUP BY lang""")
def embed_model_counts(spark, sf):
    return embed_counts(failing_documents(spark, sf), "lang")


MODELS = {"small": 16, "large": 32}


@plan(f"""
WITH asked AS (SELECT doc_id, text, CASE WHEN lang = 'fr' THEN 'large' ELSE 'small' END AS model_name FROM documents),
small AS (SELECT * FROM asked WHERE model_name = 'small'), large AS (SELECT * FROM asked WHERE model_name = 'large'),
{sql_embed('small', 'embedded_small', 'text', 16)}, {sql_embed('large', 'embedded_large', 'text', 32)},
every AS (SELECT doc_id, model_name, embedding FROM embedded_small
          UNION ALL SELECT doc_id, model_name, embedding FROM embedded_large)
{sql_per_component('every', 'doc_id', 'model_name')}""")
def embed_by_model(spark, sf):
    asked = F.when(F.col("lang") == "fr", "large").when(F.col("lang") == "de", "")
    docs = table(spark, sf, "documents").select("doc_id", "text", asked.alias("model"))
    embedded = by_model(spread(docs, "doc_id"), lambda name: hash_encoder(MODELS[name]), "small")
    return per_component(embedded.filter("embed_error is null"), "doc_id", "model_name")
