"""One query per operator over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import automaton, capfilters, contamination, jaccard, language, licenses, lines, packing, quality, substrings, trie, urls, whitening
from .registry import QUERIES, SQL, query

__all__ = ["QUERIES", "SQL"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(parts: int, id_col: str = "doc_id"):
    """Which of ``parts`` folds a document is in."""
    return F.crc32(F.col(id_col).cast("string")) % parts


@query()
def op1_language_codes(spark, sf_dir):
    """Every document's language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit_languages(docs, key=F.col("doc_id"), trainable=fold(5) != 0)
    found = language.predict_languages(docs, model)
    return found.withColumn("held_out", fold(5) == 0)


@query()
def op2_quality_classifier(spark, sf_dir):
    """Every document's probability of being marked good."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"), trainable=fold(5, "id") != 0)
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)


@query(f"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES {_RULES_SQL}),
parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
ranked AS (
  SELECT page_id, host, path, r_host || r_path AS rule, r_verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(r_host || r_path) DESC NULLS LAST) AS place
  FROM parts LEFT JOIN rules
    ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict FROM ranked WHERE place = 1""")
def op3_url_filter(spark, sf_dir):
    """The verdict on every page's url."""
    return urls.judge_urls(table(spark, sf_dir, "pages"), urls.rules_frame(spark, RULES))


@query(r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM tokens),
sets AS (SELECT s, min(doc_id) AS rep FROM (SELECT doc_id, list_sort(s) AS s FROM shingles WHERE len(s) > 0) GROUP BY s),
grams AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.rep AS a, b.rep AS b FROM grams a JOIN grams b ON a.g = b.g AND a.rep < b.rep
    AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 9 * count(*) >= 4 * (a.n + b.n)),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(node, low) AS (
  SELECT rep, rep FROM sets UNION
  SELECT e.b, r.low FROM reach r JOIN edges e ON e.a = r.node),
lowest AS (SELECT node, min(low) AS low FROM reach GROUP BY node),
named AS (SELECT x.doc_id, len(x.s) AS n, s.rep FROM shingles x LEFT JOIN sets s ON list_sort(x.s) = s.s)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(low, doc_id) AS component_id
FROM named LEFT JOIN lowest ON node = rep""")
def op5_jaccard_join(spark, sf_dir):
    """Groups of documents whose five-word shingle sets are at least 0.8 alike."""
    return jaccard.similar_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op4_substring_dedup(spark, sf_dir):
    """Documents without the bytes of 200-byte strings that occur more than once."""
    done = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["begin"])
    return done.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


_COSINE = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query(f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE {_COSINE} >= 0.93),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a),
reach(node, low) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.node),
lowest AS (SELECT node AS vec_id, min(low) AS component_id FROM reach GROUP BY node)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN counts USING (vec_id) JOIN lowest USING (vec_id)""")
def op6_cap_filters(spark, sf_dir):
    """Links of every embedding with those of its label at a cosine of at least 0.93."""
    return capfilters.near_vectors(table(spark, sf_dir, "embeddings"))


@query()
def op7_best_fit_packing(spark, sf_dir):
    """Every document as token pieces packed into sequences of 1024."""
    packed = packing.pack(table(spark, sf_dir, "documents"))
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query(r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM split),
frequent AS (
  SELECT key, max(doc_id) AS last_id FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.last_id AS gone
  FROM keyed k LEFT JOIN frequent f USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""")
def op8_line_dedup(spark, sf_dir):
    """Documents without the lines that at least five of them share."""
    done = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return done.select("doc_id", "n_lines", "n_dropped", sha)


@query()
def op9_decontamination(spark, sf_dir):
    """Every benchmark item in every document that holds it."""
    return contamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op10_backoff_automaton(spark, sf_dir):
    """Every document's log-probability, learned from six sevenths of them."""
    return automaton.score_texts(table(spark, sf_dir, "documents"), trainable=fold(7) != 2)


@query()
def op11_license_rules(spark, sf_dir):
    """Every document's license phrases and the labels of all rules that hold."""
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("detections", lambda d: d["always"])
    starts = F.transform(base, lambda d: d["first_word"])
    joined = lambda some: F.array_join(F.array_sort(F.array_distinct(F.transform(some, lambda d: d["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.filter("detections", lambda d: d["label"] != "")).alias("labels"),
        "score",
    )


@query()
def op12_lanczos_whitening(spark, sf_dir):
    """Every usable embedding on the first 32 whitened components."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.whiten(vectors).withColumn("deviation", F.col("deviation").try_cast("long"))


@query(r"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
lengths AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id),
folds AS (
  SELECT conv_id AS c, conv_id - conv_id % 100 AS b,
         xor(list_reduce([CAST(4294967295 AS BIGINT)] || flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
               lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
             lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) ELSE xor(r >> 1, (r & 1) * 3988292384) END), 4294967295) % 6 AS h
  FROM lengths),
known AS (SELECT f.*, least(h, coalesce(n, 0)) AS a FROM folds f LEFT JOIN lengths ON conv_id = b),
rebuilt AS (
  SELECT c, pos AS d, role, text FROM known JOIN turns ON conv_id = b AND pos <= h
  UNION ALL SELECT c, a + pos - h, role, text FROM known JOIN turns ON conv_id = c AND pos > h),
members AS (
  SELECT c, d, string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY d) AS key,
         length(text) AS n_chars FROM rebuilt
  UNION ALL SELECT c, 0, '', 0 FROM known),
nodes AS (SELECT d, key, min(c) AS conv_id, count(*) AS n_convs, min(n_chars) AS n_chars FROM members GROUP BY d, key),
families AS (SELECT d - 1 AS d, left(key, 64 * (d - 1)) AS key, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2),
counted AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN families USING (d, key)),
lines AS (SELECT *, unnest(range(0, CAST(d AS INT) + 1)) AS up FROM counted),
subtrees AS (
  SELECT up AS d, left(key, 64 * up) AS key, count(*) FILTER (n_children = 0) AS n_leaves,
         CAST(sum((n_convs - 1) * n_chars) AS BIGINT) AS saved_tokens
  FROM lines GROUP BY 1, 2),
lasts AS (SELECT c, max(d) AS d, max_by(key, d) AS key FROM members GROUP BY c),
ends AS (SELECT d, key, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS sha FROM lasts GROUP BY d, key)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens,
       coalesce(sha, sha256('')) AS ends_sha256
FROM counted n LEFT JOIN nodes p ON p.d = n.d - 1 AND p.key = left(n.key, 64 * (n.d - 1))
JOIN subtrees s ON s.d = n.d AND s.key = n.key LEFT JOIN ends e ON e.d = n.d AND e.key = n.key""")
def op13_prefix_trie(spark, sf_dir):
    """Every node of the trie over the rebuilt conversations."""
    return trie.conversation_trie(table(spark, sf_dir, "conversations")).drop("enter_at", "leave_at")
