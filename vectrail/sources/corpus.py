"""Corpus readers: parquet, a choice of its files, JSON lines, partitioned articles."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import DEFAULT_LANGUAGE, LANGUAGE_CODES
from ..schemas import ARTICLE, NEWS, PAPER, PARTITIONED_ARTICLE

DEFAULT_DUMP_DATE = "20231101"


def check_budget(token_length: int, name: str = "token_length") -> None:
    if token_length <= 0:
        raise ValueError(f"{name} must be positive")


def _present(read, path: str) -> DataFrame:
    try:
        return read()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(path) from error
        raise


def news(spark: SparkSession, path: str) -> DataFrame:
    """Every parquet file of a folder, title and article only."""
    found = _present(lambda: spark.read.schema(NEWS).parquet(path), path)
    if not found.inputFiles():
        raise FileNotFoundError(f"no parquet files in {path}")
    return found.select(*NEWS.fieldNames())


def news_files(spark: SparkSession, path: str, file_indices: Sequence[int] | None) -> DataFrame:
    """The files at these positions of the sorted listing; others are not read."""
    everything = news(spark, path)
    if file_indices is None:
        return everything
    files = sorted(everything.inputFiles())
    chosen = []
    for index in file_indices:
        if 0 <= index < len(files):
            chosen.append(files[index])
        else:
            warnings.warn(f"file index {index} is outside 0-{len(files) - 1}", stacklevel=2)
    if not chosen:
        return spark.createDataFrame([], NEWS)
    return spark.read.schema(NEWS).parquet(*chosen).select(*NEWS.fieldNames())


def papers(spark: SparkSession, path: str) -> DataFrame:
    """S3: one JSON object per line; lines that do not parse are dropped.

    A gzip file is one task whatever its size, so callers spread the rows before heavy
    work (``session.spread``).
    """
    return _present(
        lambda: spark.read.schema(PAPER).option("mode", "DROPMALFORMED").json(path), path
    )


def articles(
    spark: SparkSession, path: str, language: str = DEFAULT_LANGUAGE, date: str = DEFAULT_DUMP_DATE
) -> DataFrame:
    """One language of one dump; the filter prunes the ``date=/lang=`` folders."""
    table = _present(lambda: spark.read.schema(PARTITIONED_ARTICLE).parquet(path), path)
    code = LANGUAGE_CODES.get(language.strip().lower(), DEFAULT_LANGUAGE)
    return table.filter((F.col("date") == date) & (F.col("lang") == code)).select(
        *ARTICLE.fieldNames()
    )
