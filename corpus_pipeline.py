"""From documents to packed training sequences: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.llm import contamination, jaccard, lines, packing, quality
from vectrail.llm.queries import fold, table
from vectrail.llm.registry import free
from vectrail.llm.scratch import discard, stored

ORACLE_SQL = None  # SQL has neither zstandard dictionaries nor token ids


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null and empty texts get the score of no length. Without labelled texts of both classes all
    documents get the same score, and stay unless every label is bad. Columns pass on, whatever
    their names; repeated rows are judged alike; no documents give none.
    """
    score, predicted = free(docs.columns, "score"), free(docs.columns, "predicted")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"), trainable=fold(5, "id") != 0)
    scored = quality.score_quality(docs, model, score_col=score, predicted_col=predicted)
    return scored.where(F.col(predicted) == 1).select(*docs.columns)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that five or more share; ``n_chars`` follows the text.

    A null text stays null. Rows with a null id count as documents of their own and never keep a
    shared line. Columns pass on, whatever their names; no documents give none.
    """
    names = [free(docs.columns, name) for name in ("n_lines", "n_dropped")]
    done = lines.dedup_lines(docs, lines_col=names[0], dropped_col=names[1]).drop(*names)
    if "n_chars" in done.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def keyed_rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of a row's document: rows of the same id and text are repeated rows; ids may be null or shared by several texts."""
    key = free(docs.columns, "row_key")
    return docs.withColumn(key, F.xxhash64("doc_id", "text")), key


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of similar ones, null ids last; repeated rows of it go too.

    Texts without words are alike with nothing and stay. Columns pass on, whatever their names; no
    documents give none.
    """
    keyed, key = keyed_rows(docs)
    groups = jaccard.similar_groups(keyed.select(F.col(key).alias("row_key"), "text"), "row_key").select("row_key", "component_id").distinct()
    members = groups.join(keyed.select(F.col(key).alias("row_key"), "doc_id").distinct(), "row_key")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    first = members.groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first.row_key").alias(key))
    return keyed.join(first, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Texts without words hold none, and neither do items without words. Columns pass on, whatever
    their names; no documents give none.
    """
    keyed, key = keyed_rows(docs)
    leaks = contamination.find_leaks(keyed.select(F.col(key).alias("row_key"), "text"), table(spark, sf_dir, "benchmark"), "row_key")
    return keyed.join(leaks.select(F.col("row_key").alias(key)).distinct(), key, "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences.

    A null or empty text is one end id; repeated rows are packed each; other columns are left out.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_shared_lines),
    ("n-gram jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result is written and read again."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        discard(*before)
        before = [docs]
    return docs
