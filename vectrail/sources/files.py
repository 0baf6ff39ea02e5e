"""File readers for ingestion: whole texts, NDJSON, lines, embedding files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.messages import json_type, parsed, text_at, truthy_text
from ..functions.text import is_blank, strip
from ..schemas import EMBEDDING_FILE


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every ``.txt`` file (any case) is one stripped document."""
    return (
        spark.read.option("pathGlobFilter", "*.[tT][xX][tT]")
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_name").alias("file"), strip(F.col("value")).alias("text"))
    )


NDJSON_FILES = "*.{ndjson,jsonl,NDJSON,JSONL}"


def ndjson(
    spark: SparkSession,
    path: str,
    text_field: str = "text",
    id_field: str = "id",
    files: str = NDJSON_FILES,
) -> DataFrame:
    """Records with a string under ``text_field``; blank lines, bad JSON, other types
    and blank texts are skipped. A missing id is derived from the file's whole path and the text, so
    files of one name in two folders give two messages and reading again gives the same ids; equal
    lines without an id in one file are one message."""
    v = F.col("_v")
    lines = (
        spark.read.option("pathGlobFilter", files)
        .text(path)
        .select(
            F.col("_metadata.file_name").alias("file"),
            F.col("_metadata.file_path").alias("_path"),
            parsed(F.col("value")).alias("_v"),
        )
    )
    text, id_ = f"$.{text_field}", f"$.{id_field}"
    return (
        lines.select(
            "file",
            "_path",
            truthy_text(v, id_).alias("given_id"),
            F.when(json_type(v, text) == "STRING", text_at(v, text)).alias("text"),
        )
        .filter(~is_blank(F.col("text")))
        .select(
            "file",
            F.coalesce("given_id", F.md5(F.concat_ws(":", "_path", "text"))).alias("id"),
            "text",
        )
    )


def lines(spark: SparkSession, path: str) -> DataFrame:
    """One message per non-empty stripped line."""
    return (
        spark.read.text(path)
        .select(F.col("_metadata.file_name").alias("file"), strip(F.col("value")).alias("text"))
        .filter("text <> ''")
    )


def embedding_files(spark: SparkSession, path: str) -> DataFrame:
    """The vector of each JSON file; files without one are rejected."""
    return (
        spark.read.schema(EMBEDDING_FILE)
        .option("multiLine", True)
        .json(path)
        .select(
            F.col("_metadata.file_name").alias("file"),
            F.col("embedding").cast("array<float>").alias("embedding"),
            "model_name",
        )
        .filter("size(embedding) > 0")
    )
