"""Session helpers: a local session for tests, shared scratch space, input spreading."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: dict[str, str] = {}


def local_session(cores: str = "8", memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A single-JVM session as used by the tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("vectrail")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session that names none gets a folder of its own; on a cluster a
    machine-local folder would be invisible to the executors, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return _LOCAL_ROOT.setdefault(context.applicationId, tempfile.mkdtemp(prefix="vectrail-"))


def new_scratch(spark: SparkSession, label: str) -> str:
    """A fresh path under the scratch root; nothing is created yet."""
    return f"{scratch_root(spark)}/vectrail/{label}-{uuid.uuid4().hex[:12]}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give CPU-heavy work at least one partition per core.

    A scan that already has enough splits (any large input) is left alone, so the
    extra shuffle is paid only for inputs of a few files. So is anything that was shuffled
    already, which asking for its partitions would run.
    """
    if re.search(r"(?<!Broadcast)Exchange ", df._jdf.queryExecution().executedPlan().toString()):
        return df
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted, *keys)
