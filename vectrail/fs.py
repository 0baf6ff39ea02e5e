"""File-system questions asked through Hadoop, so any store Spark reads works here."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, jvm_path = _open(spark, path)
    return fs.exists(jvm_path)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names directly under ``path``, sorted; empty when the folder is absent."""
    fs, jvm_path = _open(spark, path)
    if not fs.exists(jvm_path):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(jvm_path))


def is_committed(spark: SparkSession, path: str) -> bool:
    """True once the job that wrote this folder committed."""
    return exists(spark, f"{path}/_SUCCESS")


def remove(spark: SparkSession, path: str) -> None:
    fs, jvm_path = _open(spark, path)
    fs.delete(jvm_path, True)


def size_bytes(spark: SparkSession, path: str) -> int:
    """Bytes stored under ``path``; 0 when it is absent."""
    fs, jvm_path = _open(spark, path)
    return fs.getContentSummary(jvm_path).getLength() if fs.exists(jvm_path) else 0
