"""Tables written once to the shared folder and read again: they cut lineage and survive lost executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..fs import remove, size_bytes
from ..session import new_scratch, scratch_root


# Bytes of an Arrow batch; JVM and Python hold one several times over, and Spark's own bound is 64 MB.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """From now on whole texts go to Python in batches of at most ``BATCH_BYTES``, unless a smaller bound is set."""
    if int(spark.conf.get(_BATCH).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def stored(df: DataFrame, label: str, *, buckets: str | None = None) -> DataFrame:
    """The rows of ``df``, computed once."""
    bound_batches(df.sparkSession)
    path = new_scratch(df.sparkSession, label)
    writer = df.write.partitionBy(buckets) if buckets else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folder(df: DataFrame) -> str | None:
    files = df.inputFiles()
    return files[0].rsplit("/", 1)[0] if files else None


def stored_bytes(df: DataFrame) -> int:
    """Bytes on disk behind a table that ``stored`` gave; 0 if it has no rows."""
    folder = _folder(df)
    return size_bytes(df.sparkSession, folder) if folder else 0


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` gave, once nothing that is still to be computed reads them."""
    for df in tables:
        folder = _folder(df)
        if folder and folder.rsplit("/", 2)[0].endswith(scratch_root(df.sparkSession).split(":")[-1]):
            remove(df.sparkSession, folder)
