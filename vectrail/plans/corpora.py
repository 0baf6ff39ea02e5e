"""Chunkers and corpora over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chunk as c
from ..operators.limits import HEAP_ROWS, first_rows
from ..operators import corpora as ops
from ..operators.metrics import chunk_stats as stats
from ..operators.metrics import corpus_report as report
from ..functions.text import chunk_features
from ..session import spread
from .inputs import (
    PAPER_LEAD,
    PAPER_TITLE,
    WIKI_LEAD,
    WIKI_TITLE,
    articles,
    news,
    papers,
    quoted,
    sql_clean_latex,
    sql_clean_wiki,
    sql_compose,
    sql_paragraph_chunks,
    sql_word_chunks,
    table,
)
from .registry import plan

BUDGET = 128
SHOWN = "doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, md5(chunk) AS chunk"

PLAIN = "plain AS (SELECT doc_id, text AS document FROM documents)"
NEWS = "news AS (SELECT doc_id, 'Document ' || doc_id || chr(10) || chr(10) || text AS document FROM documents)"
PAPERS = f"""
paper AS (SELECT doc_id, {sql_clean_latex(f"{quoted(PAPER_TITLE)} || doc_id")} AS title,
                 {sql_clean_latex(f"{quoted(PAPER_LEAD)} || text")} AS body, lang, source FROM documents),
papers AS (SELECT doc_id, {sql_compose('title', 'body')} AS document, lang, source FROM paper)"""
ARTICLES = f"""
article AS (SELECT doc_id, {sql_clean_wiki(f"{quoted(WIKI_TITLE)} || doc_id || ' =='")} AS title,
                   {sql_clean_wiki(f"{quoted(WIKI_LEAD)} || text")} AS body FROM documents),
articles AS (SELECT doc_id, {sql_compose('title', 'body')} AS document FROM article)"""


def shown(chunks):
    return chunks.select("doc_id", "chunk_index", F.md5("chunk").alias("chunk"))


def documents(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


@plan(f"WITH RECURSIVE {PLAIN}, {sql_word_chunks('plain', BUDGET)} SELECT {SHOWN} FROM chunks")
def chunk_words(spark, sf):
    return shown(c.explode_chunks(documents(spark, sf), c.word_chunks(F.col("text"), BUDGET), "doc_id"))


PARAGRAPHS = """plain AS (
  SELECT doc_id, 'Document ' || doc_id || chr(10) || chr(10) ||
         replace(text, chr(10), chr(10) || chr(10)) AS document FROM documents)"""


@plan(f"WITH RECURSIVE {PARAGRAPHS}, {sql_paragraph_chunks('plain', BUDGET)} SELECT {SHOWN} FROM chunks")
def chunk_paragraphs(spark, sf):
    text = F.concat(
        F.lit("Document "), F.col("doc_id"), F.lit("\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n"))
    )
    return shown(c.explode_chunks(documents(spark, sf), c.paragraph_chunks(text, BUDGET), "doc_id"))


@plan(f"""
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, md5(substr(text, i * {BUDGET * 4} + 1, {BUDGET * 4})) AS chunk
FROM (SELECT doc_id, text, unnest(range(0, (length(text) + {BUDGET * 4} - 1) // {BUDGET * 4})) AS i FROM documents)""")
def chunk_fixed(spark, sf):
    return shown(ops.fixed_width_chunks(documents(spark, sf), "text", BUDGET, "doc_id"))


@plan(f"WITH RECURSIVE {NEWS}, {sql_word_chunks('news', BUDGET)} SELECT {SHOWN} FROM chunks")
def corpus_news_chunks(spark, sf):
    return shown(ops.news_chunks(spread(news(spark, sf), "doc_id"), BUDGET, "doc_id"))


@plan(f"WITH RECURSIVE {PAPERS}, {sql_word_chunks('papers', BUDGET)} SELECT {SHOWN} FROM chunks")
def corpus_arxiv_chunks(spark, sf):
    return shown(ops.paper_chunks(spread(papers(spark, sf), "doc_id"), BUDGET, "doc_id"))


@plan(f"WITH RECURSIVE {ARTICLES}, {sql_paragraph_chunks('articles', BUDGET)} SELECT {SHOWN} FROM chunks")
def corpus_wiki_chunks(spark, sf):
    return shown(ops.article_chunks(spread(articles(spark, sf), "doc_id"), BUDGET, "doc_id"))


@plan("SELECT doc_id FROM documents WHERE lang IN ('fr', 'de') OR source IN ('fr', 'de', 'src3')")
def filter_categories(spark, sf):
    return ops.filter_categories(papers(spark, sf), ["fr", "de", "src3"]).select("doc_id")


@plan("SELECT doc_id FROM documents WHERE lang = 'fr' OR source = 'src3'")
def filter_categories_split(spark, sf):
    joined = papers(spark, sf).withColumn("categories", F.array(F.array_join("categories", " ")))
    return ops.filter_categories(joined, ["fr", "src3"], split_tokens=True).select("doc_id")


SAMPLE = 100


@plan(f"""WITH RECURSIVE {PAPERS}, first AS (SELECT * FROM papers ORDER BY doc_id LIMIT {SAMPLE}),
{sql_word_chunks('first', BUDGET)} SELECT {SHOWN} FROM chunks""")
def corpus_sample(spark, sf):
    first = ops.sample_documents(papers(spark, sf), SAMPLE, "doc_id")
    return shown(ops.paper_chunks(first, BUDGET, "doc_id"))


@plan(f"""
SELECT lang, CAST(count(*) AS BIGINT) AS documents, 2 AS ways
FROM (SELECT lang FROM documents ORDER BY lang LIMIT {SAMPLE} OFFSET 7) GROUP BY lang""")
def corpus_sample_ties(spark, sf):
    """An order column with many equal values gives the same rows whichever way they are found."""
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    ways = [first_rows(docs, SAMPLE, "lang", skip=7, heap_rows=n) for n in (0, HEAP_ROWS)]
    both = ways[0].unionByName(ways[1]).groupBy("doc_id", "lang").count()
    return both.groupBy("lang").agg(F.count("*").alias("documents"), F.max("count").cast("int").alias("ways"))


CAP = 100


@plan(f"""WITH RECURSIVE {NEWS}, {sql_word_chunks('news', BUDGET)}
SELECT {SHOWN} FROM chunks ORDER BY doc_id, chunk_index LIMIT {CAP}""")
def corpus_chunk_cap(spark, sf):
    return shown(ops.capped_chunks(news(spark, sf), "cc_news", BUDGET, CAP))


@plan(f"""WITH RECURSIVE {PAPERS}, first AS (SELECT * FROM papers ORDER BY doc_id LIMIT {CAP // 10}),
{sql_word_chunks('first', BUDGET)} SELECT {SHOWN} FROM chunks ORDER BY doc_id, chunk_index LIMIT {CAP}""")
def corpus_chunk_sample(spark, sf):
    """At most so many chunks of a tenth as many documents."""
    return shown(ops.sampled_chunks(papers(spark, sf), "arxiv", BUDGET, CAP))


def all_datasets(spark, sf):
    return ops.dataset_chunks(
        {
            "cc_news": news(spark, sf),
            "arxiv": papers(spark, sf),
            "wikipedia": articles(spark, sf).drop("lang"),
        },
        BUDGET,
    )


def _all_datasets_sql() -> str:
    """The three corpora one after the other; ids are kept apart by a tag."""
    return f"""{NEWS}, {PAPERS}, {ARTICLES},
tagged AS (
  SELECT 'cc_news:' || doc_id AS doc_id, document FROM news
  UNION ALL SELECT 'arxiv:' || doc_id, document FROM papers),
words AS (WITH RECURSIVE {sql_word_chunks('tagged', BUDGET)} SELECT * FROM chunks),
tagged_articles AS (SELECT 'wikipedia:' || doc_id AS doc_id, document FROM articles),
paragraphs AS (WITH RECURSIVE {sql_paragraph_chunks('tagged_articles', BUDGET)} SELECT * FROM chunks),
every AS (
  SELECT split_part(doc_id, ':', 1) AS dataset, CAST(split_part(doc_id, ':', 2) AS BIGINT) AS doc_id,
         chunk_index, chunk,
         CASE WHEN starts_with(doc_id, 'wikipedia') THEN greatest(1, length(chunk) // 4)
              ELSE length(chunk) // 4 END AS tokens
  FROM (SELECT * FROM words UNION ALL SELECT * FROM paragraphs))"""


@plan(f"""WITH {_all_datasets_sql()}
SELECT dataset, {SHOWN}, CAST(tokens AS BIGINT) AS tokens FROM every""")
def dataset_chunks(spark, sf):
    return all_datasets(spark, sf).select(
        "dataset", "doc_id", "chunk_index", F.md5("chunk").alias("chunk"), F.col("tokens").cast("bigint")
    )


@plan(f"""WITH {_all_datasets_sql()}
SELECT dataset, count(*) AS chunks, CAST(sum(tokens) AS BIGINT) AS total_tokens,
       round(avg(tokens), 6) AS avg_tokens_per_chunk
FROM every GROUP BY dataset""")
def corpus_report(spark, sf):
    return report(all_datasets(spark, sf)).withColumn(
        "avg_tokens_per_chunk", F.round("avg_tokens_per_chunk", 6)
    )


@plan(f"""WITH RECURSIVE {PAPERS}, {sql_word_chunks('papers', BUDGET)}
SELECT count(*) AS chunks, CAST(sum(length(chunk) // 4) AS BIGINT) AS total_tokens,
       round(avg(length(chunk) // 4), 6) AS avg_tokens,
       count(*) FILTER (contains(chunk, '$') OR contains(lower(chunk), 'equation')) AS math_chunks,
       count(*) FILTER (regexp_matches(lower(chunk), 'algorithm|network|system|computer')) AS technical_chunks,
       count(*) FILTER (length(string_split(chunk, chr(10))[1]) < 100
                        AND NOT ends_with(string_split(chunk, chr(10))[1], '.')) AS title_chunks,
       CAST(sum(length(chunk)) // count(*) AS BIGINT) AS avg_length
FROM chunks""", name="chunk_stats")
def chunk_statistics(spark, sf):
    chunks = ops.paper_chunks(spread(papers(spark, sf), "doc_id"), BUDGET, "doc_id")
    return stats(chunks, chunk_features(F.col("chunk"))).withColumn(
        "avg_tokens", F.round("avg_tokens", 6)
    )
