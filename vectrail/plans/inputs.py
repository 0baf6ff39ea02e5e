"""The given tables, the stand-ins derived from them, and the matching SQL fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embed import M1, M2, jump_multipliers
from ..session import new_scratch

BASE = 1704067200  # 2024-01-01T00:00:00Z
NOW = BASE + 5400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now(seconds: int = NOW):
    return F.timestamp_seconds(F.lit(seconds))


_STAGED: dict[tuple, str] = {}


def staged(
    spark: SparkSession, sf_dir: str, label: str, write: Callable[[str], None]
) -> str:
    """A whole table written once per session in a source's own format; gives its path."""
    key = (spark.sparkContext.applicationId, sf_dir, label)
    if key not in _STAGED:
        path = new_scratch(spark, label)
        write(path)
        _STAGED[key] = path
    return _STAGED[key]


# --- text messages and their embeddings -----------------------------------------------
def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("text").alias("content"),
        "source",
        F.timestamp_seconds(F.lit(BASE) + F.col("doc_id")).alias("created_at"),
        F.timestamp_seconds(F.lit(BASE) + F.col("doc_id") + F.col("n_chars") % 3600).alias("processed_at"),
    )


MESSAGES_SQL = f"""
messages AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, text AS content, source,
         {BASE} + doc_id AS created_at, {BASE} + doc_id + n_chars % 3600 AS processed_at
  FROM documents)"""


def done_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that count as embedded already: the labelled documents."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("text_message_id"))


# --- corpora ---------------------------------------------------------------------------
def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("Document "), F.col("doc_id")).alias("title"),
        F.col("text").alias("article"),
    )


PAPER_TITLE = "\\textbf{Paper}  \\beta "
PAPER_LEAD = "Let \\alpha solve \\emph{the equation} $x$.\n \\cite{a1} "


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("doc_id").cast("string").alias("id"),
        F.concat(F.lit(PAPER_TITLE), F.col("doc_id")).alias("title"),
        F.concat(F.lit(PAPER_LEAD), F.col("text")).alias("abstract"),
        F.array("lang", "source").alias("categories"),
    )


WIKI_TITLE = "== [[Page|Article]]  ''No'' "
WIKI_LEAD = (
    "{{Infobox|x=1}}'''Bold''' see [[Target|the label]] and [[Plain]],\n\n"
    "[http://example.org/a?b=1 a site] <!-- hidden\n note --> [[Category:Test]] end.\n\n"
)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit(WIKI_TITLE), F.col("doc_id"), F.lit(" ==")).alias("title"),
        F.concat(F.lit(WIKI_LEAD), F.col("text")).alias("text"),
        F.concat(F.lit("http://example.org/"), F.col("doc_id")).alias("url"),
        "lang",
    )


# --- SQL fragments ----------------------------------------------------------------------
WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_strip(expr: str) -> str:
    return rf"regexp_replace({expr}, '^{WS}+|{WS}+$', '', 'g')"


def sql_collapse(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{WS}+', ' ', 'g'), ' ')"


def sql_clean_latex(expr: str) -> str:
    out = sql_collapse(expr)
    out = rf"regexp_replace({out}, '\\[a-zA-Z]+\{{([^}}]*)\}}', '\1', 'g')"
    out = rf"regexp_replace({out}, '\\([a-zA-Z])', '\1', 'g')"
    return sql_strip(out)


def sql_clean_wiki(expr: str) -> str:
    inner = WS[1:-1]
    out = sql_collapse(expr)
    out = rf"regexp_replace({out}, '\{{\{{[^}}]*\}}\}}', '', 'g')"
    out = rf"regexp_replace({out}, '\[\[([^|\]]*\|)?([^\]]*)\]\]', '\2', 'g')"
    out = rf"regexp_replace({out}, '\[http[^{inner}\]]*{WS}*([^\]]*)\]', '\1', 'g')"
    out = rf"regexp_replace({out}, '(?s)<!--.*?-->', '', 'g')"
    out = rf"regexp_replace({out}, '''{{2,}}', '', 'g')"
    out = rf"regexp_replace({out}, '(?m)^{WS}*=+{WS}*(.+?){WS}*=+{WS}*$', '\1', 'g')"
    return sql_strip(out)


def sql_compose(title: str, body: str) -> str:
    return (
        f"CASE WHEN {title} <> '' AND {body} <> '' THEN {title} || chr(10) || chr(10) || {body} "
        f"WHEN {title} <> '' THEN {title} WHEN {body} <> '' THEN {body} END"
    )


def sql_pieces_to_chunks(budget: int, cost: str) -> str:
    """CTEs from ``pieces(doc_id, w)`` to ``chunks(doc_id, chunk_index, chunk)``.

    Independent of the Spark fold: prefix sums give each piece the start of the chunk that
    would follow one opened there; a recursion walks these links.
    """
    return f"""
costs AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS i,
         unnest(list_transform(w, lambda x: {cost})) AS c
  FROM pieces),
sums AS (
  SELECT doc_id, i, c, sum(c) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS p
  FROM costs),
marks AS (
  SELECT doc_id, p AS level, 1 AS step, i FROM sums
  UNION ALL SELECT doc_id, p - c + {budget}, 0, i FROM sums),
links AS MATERIALIZED (
  SELECT doc_id, i, CASE WHEN following IS NOT NULL THEN greatest(following, i + 1) END AS following
  FROM (SELECT doc_id, i, step,
               last_value(CASE WHEN step = 1 THEN i END IGNORE NULLS) OVER (
                 PARTITION BY doc_id ORDER BY level DESC, step, i DESC
                 ROWS UNBOUNDED PRECEDING) AS following
        FROM marks)
  WHERE step = 0),
walk(doc_id, chunk_index, i) AS (
  SELECT doc_id, 0, 1 FROM pieces WHERE len(w) > 0
  UNION ALL
  SELECT w.doc_id, w.chunk_index + 1, l.following
  FROM walk w JOIN links l ON w.doc_id = l.doc_id AND w.i = l.i
  JOIN pieces p ON p.doc_id = w.doc_id
  WHERE l.following IS NOT NULL AND l.following <= len(p.w)),
chunks AS (
  SELECT k.doc_id, k.chunk_index,
         array_to_string(list_slice(p.w, k.i,
           coalesce(lead(k.i) OVER (PARTITION BY k.doc_id ORDER BY k.chunk_index), len(p.w) + 1) - 1), ' ') AS chunk
  FROM walk k JOIN pieces p ON p.doc_id = k.doc_id)"""


def sql_word_chunks(source: str, budget: int) -> str:
    """CTEs from a relation ``source(doc_id, document)`` to ``chunks``."""
    return (
        f"""
pieces AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(document, '{WS}+'), lambda x: x <> '') AS w
  FROM {source}),"""
        + sql_pieces_to_chunks(budget, "(length(x) + 1) // 4")
    )


def sql_paragraph_chunks(source: str, budget: int) -> str:
    return (
        f"""
pieces AS MATERIALIZED (
  SELECT doc_id, list_filter(list_transform(string_split(document, chr(10) || chr(10)),
         lambda x: {sql_strip('x')}), lambda x: x <> '') AS w
  FROM {source}),"""
        + sql_pieces_to_chunks(budget, "greatest(1, (length(x) + 1) // 4)")
    )


def sql_embed(source: str, target: str, text: str, dim: int) -> str:
    """CTEs adding ``embedding`` (FLOAT list of unit length) to every row of ``source``."""
    first, second = jump_multipliers(dim)
    pairs = ", ".join(f"{{'a': {a}, 'b': {b}}}" for a, b in zip(first, second))
    word = "CAST('0x' || substr(md5({t}), {i}, 8) AS BIGINT) % ({m} - 1) + 1"
    return f"""
{target}_seed AS (
  SELECT *, {word.format(t=text, i=1, m=M1)} AS _s1, {word.format(t=text, i=9, m=M2)} AS _s2 FROM {source}),
{target}_raw AS (
  SELECT * EXCLUDE (_s1, _s2), list_transform([{pairs}], lambda z:
    ((((_s1 * z.a) % {M1} - (_s2 * z.b) % {M2}) % {M1 - 1} + {M1 - 1}) % {M1 - 1})
    * (CAST(2.0 AS DOUBLE) / {M1 - 1}) - 1.0) AS _raw
  FROM {target}_seed),
{target} AS (
  SELECT * EXCLUDE (_raw), list_transform(_raw, lambda x:
    CAST(x / sqrt(list_sum(list_transform(_raw, lambda y: y * y))) AS FLOAT)) AS embedding
  FROM {target}_raw)"""


def sql_distance(a: str, b: str) -> str:
    return f"list_cosine_distance(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
