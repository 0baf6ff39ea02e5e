"""Token estimates, cleaners, previews and text predicates over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..session import spread
from .inputs import (
    PAPER_LEAD,
    WIKI_LEAD,
    WS,
    articles,
    papers,
    quoted,
    sql_clean_latex,
    sql_clean_wiki,
    sql_compose,
    sql_strip,
    table,
)
from .registry import plan


@plan("SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def estimate_tokens(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", t.estimate_tokens(F.col("text")).cast("bigint").alias("tokens")
    )


@plan("""
SELECT event_id, CASE WHEN event_type = 'view' THEN 0 ELSE greatest(1, length(event_type) // 4) END AS tokens
FROM events""")
def estimate_tokens_min1(spark, sf):
    word = F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type"))
    return table(spark, sf, "events").select(
        "event_id", t.estimate_tokens_min1(word).cast("bigint").alias("tokens")
    )


@plan("SELECT event_id, CAST(trunc(value * 1024 / 4) AS INTEGER) AS tokens FROM events")
def kb_to_tokens(spark, sf):
    return table(spark, sf, "events").select("event_id", t.kb_to_tokens(F.col("value")).alias("tokens"))


@plan(f"""
SELECT doc_id, md5({sql_clean_latex(f"{quoted(PAPER_LEAD)} || text")}) AS cleaned
FROM documents""")
def clean_latex(spark, sf):
    return spread(papers(spark, sf), "doc_id").select("doc_id", F.md5(t.clean_latex(F.col("abstract"))).alias("cleaned"))


@plan(f"""
SELECT doc_id, md5({sql_clean_wiki(f"{quoted(WIKI_LEAD)} || text")}) AS cleaned
FROM documents""")
def clean_wiki(spark, sf):
    return spread(articles(spark, sf), "doc_id").select("doc_id", F.md5(t.clean_wiki(F.col("text"))).alias("cleaned"))


@plan("""
SELECT doc_id, CASE lower(trim(name)) WHEN 'en' THEN 'en' WHEN 'german' THEN 'de' WHEN 'de' THEN 'de'
  WHEN 'fr' THEN 'fr' WHEN 'spanish' THEN 'es' WHEN 'es' THEN 'es' ELSE 'en' END AS code
FROM (SELECT doc_id, CASE WHEN lang = 'de' THEN ' German ' WHEN lang = 'es' THEN 'SPANISH'
             WHEN length(text) % 2 = 0 THEN lang ELSE lang || '?' END AS name FROM documents)""")
def language_code(spark, sf):
    lang = F.col("lang")
    name = (
        F.when(lang == "de", " German ")
        .when(lang == "es", "SPANISH")
        .when(F.length("text") % 2 == 0, lang)
        .otherwise(F.concat(lang, F.lit("?")))
    )
    return table(spark, sf, "documents").select("doc_id", t.language_code(name).alias("code"))


TITLE = "CASE WHEN lang <> 'fr' THEN 'Document ' || doc_id END"
BODY = "CASE WHEN lang = 'en' THEN text WHEN lang = 'de' THEN '' END"


@plan(f"""
SELECT doc_id, md5(document) AS document
FROM (SELECT doc_id, {sql_compose('title', 'body')} AS document
      FROM (SELECT doc_id, coalesce({TITLE}, '') AS title, coalesce({BODY}, '') AS body FROM documents))
WHERE document IS NOT NULL""")
def compose_document(spark, sf):
    docs = table(spark, sf, "documents")
    title = F.when(F.col("lang") != "fr", F.concat(F.lit("Document "), F.col("doc_id")))
    body = F.when(F.col("lang") == "en", F.col("text")).when(F.col("lang") == "de", "")
    composed = docs.select("doc_id", t.compose_document(title, body).alias("document"))
    return composed.filter("document is not null").select("doc_id", F.md5("document").alias("document"))


@plan("""
SELECT doc_id, substr(text, 1, 100) || '...' AS shown,
       substr(text, 1, 100) || CASE WHEN length(text) > 100 THEN '...' ELSE '' END AS preview
FROM documents""")
def preview_100(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", t.preview(text, always_dots=True).alias("shown"), t.preview(text).alias("preview")
    )


@plan(f"""
SELECT doc_id, length(text) // 4 AS token_count,
       CAST(len(list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '')) AS BIGINT) AS word_count,
       CAST(length(text) AS BIGINT) AS char_count,
       contains(text, '$') OR contains(lower(text), 'equation') AS has_math,
       contains(lower(text), 'http') OR contains(lower(text), 'www') AS has_links,
       regexp_matches(lower(text), 'algorithm|network|system|computer') AS is_technical
FROM documents""")
def chunk_features(spark, sf):
    features = t.chunk_features(F.col("text"))
    counts = ("token_count", "word_count", "char_count")
    return table(spark, sf, "documents").select(
        "doc_id",
        *[
            (c.cast("bigint") if name in counts else c).alias(name)
            for name, c in features.items()
        ],
    )


@plan("""
SELECT doc_id, length(line) < 100 AND NOT ends_with(line, '.') AS has_title
FROM (SELECT doc_id, string_split(text, chr(10))[1] AS line FROM documents)""")
def title_chunk_flag(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", t.has_title_line(F.col("text")).alias("has_title")
    )


@plan(f"""
SELECT doc_id FROM (
  SELECT doc_id, CASE WHEN source = 'src0' OR length(text) % 3 = 0 THEN ' ' || chr(9) || chr(160)
                      WHEN lang = 'es' THEN NULL ELSE text END AS text FROM documents)
WHERE text IS NOT NULL AND {sql_strip('text')} <> ''""")
def drop_blank_text(spark, sf):
    made = F.when((F.col("source") == "src0") | (F.length("text") % 3 == 0), " \t\u00a0").when(
        F.col("lang") == "es", None
    ).otherwise(F.col("text"))
    docs = table(spark, sf, "documents").select("doc_id", made.alias("text"))
    return docs.filter(~t.is_blank(F.col("text"))).select("doc_id")
