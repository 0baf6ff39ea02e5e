"""Line dedup over levelled sorted runs of line hashes.

A run is a folder of (key, documents, last document) sorted by key and split into key ranges by a
fixed hash, so runs join bucket by bucket. Every new batch is merge-anti-joined with the runs: keys
met for the first time and keys met again go to the batch's own run apart. After ``FANOUT`` runs of
a level they are merged into one run of the next, so a key is rewritten once per level.
"""

from __future__ import annotations

from functools import reduce
from hashlib import md5

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import new_scratch
from .registry import free
from .scratch import stored

# Fixed value: what is stripped at both ends of a line.
STRIPPED = b" \t\n\x0b\x0c\r"
MIN_CHARS = 40
MIN_DOCS = 5
FANOUT = 4
BATCHES = 6
_RUN = "key binary, n_docs long, last_id {id}"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Hash of a line's key; None if the key is shorter than ``min_chars`` code points."""
    key = line.strip(STRIPPED).lower()  # of bytes: A-Z only
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return md5(key).digest()


def _keys_of(min_chars: int, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            rows, keys = [], []
            for row, text in enumerate(batch.column("text")):
                found = {line_key(line, min_chars) for line in (text.as_py() or "").encode().split(b"\n")}
                found.discard(None)
                rows += [row] * len(found)
                keys += found
            ids = batch.column("id").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.binary())], schema=schema)

    return run


def _cut(min_chars: int):
    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def cut(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
        out = []
        for text, gone in zip(texts, drops):
            if gone is None:
                out.append((text, 1 if text is None else text.count("\n") + 1, 0))
                continue
            lines, gone = text.encode().split(b"\n"), set(gone)
            left = [line for line in lines if line_key(line, min_chars) not in gone]
            out.append((b"\n".join(left).decode(), len(lines), len(lines) - len(left)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

    return cut


class LineRuns:
    """Levelled sorted runs in the shared folder; ``add`` takes batches of (key, id)."""

    def __init__(self, spark: SparkSession, id_type: str, path: str | None = None, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.path = path or new_scratch(spark, "line-runs")
        self.schema = _RUN.format(id=id_type)
        self.levels: list[list[str]] = [[]]
        self.made = 0

    def _write(self, state: DataFrame) -> str:
        """Write a run: apart by state, sorted by key in every file."""
        self.made += 1
        path = f"{self.path}/run-{self.made}"
        state.sortWithinPartitions("state", "key").write.partitionBy("state").parquet(path)
        return path

    def _union(self, paths: list[str], state: str | None = None) -> DataFrame | None:
        frames = []
        for path in paths:
            df = self.spark.read.schema(f"{self.schema}, state string").parquet(path)
            frames.append(df.where(F.col("state") == state) if state else df)
        return reduce(DataFrame.unionByName, frames) if frames else None

    def runs(self) -> list[str]:
        return [path for level in self.levels for path in level]

    def add(self, batch: DataFrame) -> None:
        """Add the (key, id) rows of a batch, one per document that holds the key."""
        own = batch.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("id").alias("last_id"))
        known = self._union(self.runs(), "new")
        if known is None:
            told = own.withColumn("state", F.lit("new"))
        else:
            own = stored(own, "line-batch")
            new = own.join(known.hint("merge"), "key", "left_anti").withColumn("state", F.lit("new"))
            again = own.join(known.select("key").hint("merge"), "key", "left_semi").withColumn("state", F.lit("again"))
            told = new.unionByName(again)
        self.levels[0].append(self._write(told))
        self._compact()

    def _compact(self) -> None:
        for depth, level in enumerate(self.levels):
            if len(level) < self.fanout:
                return
            merged = self._union(level).groupBy("key").agg(
                F.sum("n_docs").alias("n_docs"),
                F.max("last_id").alias("last_id"),
                F.when(F.max((F.col("state") == "new").cast("int")) == 1, "new").otherwise("again").alias("state"),
            )
            if depth + 1 == len(self.levels):
                self.levels.append([])
            self.levels[depth + 1].append(self._write(merged))
            self.levels[depth] = []

    def totals(self, least: int) -> DataFrame:
        """Keys in at least ``least`` documents, with the largest id that holds them."""
        rows = self._union(self.runs())
        return (
            rows.groupBy("key")
            .agg(F.sum("n_docs").alias("n_docs"), F.max("last_id").alias("last_id"))
            .where(F.col("n_docs") >= least)
        )


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    batches: int = BATCHES,
    lines_col: str = "n_lines",
    dropped_col: str = "n_dropped",
) -> DataFrame:
    """``docs`` with ``text_col`` rewritten and ``lines_col``, ``dropped_col`` added (replacing columns so named).

    A line's key is the line stripped of ASCII white space at both ends, A-Z lowered. A key of at
    least ``min_chars`` code points that ``min_docs`` documents hold loses all its lines except in
    the largest id that holds it (all rows of that id, if ids repeat). Null and empty texts are one
    empty line; a null stays null. A row with a null id counts as a document but is never the
    largest. No rows give no rows. All other columns are passed on.

    Documents go into the runs in ``batches`` by a hash of their id. One row per document and key is
    shuffled, combined before the shuffle, so a line that a third of all documents hold is no hot
    key. Texts move once, to meet the list of their own dropped keys.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in (lines_col, dropped_col)]
    own_id, own_drops, own_cut = (free(kept, name) for name in ("own_id", "own_drops", "own_cut"))
    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = ids.schema["id"].dataType
    schema = pa.schema([("id", to_arrow_type(id_type)), ("key", pa.binary())])
    rows = ids.mapInArrow(_keys_of(min_chars, schema), f"id {id_type.simpleString()}, key binary")
    rows = stored(rows.withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")), "line-keys", buckets="batch")
    runs = LineRuns(spark, id_type.simpleString())
    for k in range(batches):
        runs.add(rows.where(F.col("batch") == k).select("id", "key"))
    frequent = stored(runs.totals(min_docs), "line-totals")
    drops = rows.join(frequent, "key").where(~F.col("id").eqNullSafe(F.col("last_id")))
    drops = drops.groupBy(F.col("id").alias(own_id)).agg(F.collect_set("key").alias(own_drops))
    joined = docs.select(*kept).join(drops, F.col(id_col).eqNullSafe(F.col(own_id)), "left")
    cut = joined.select(*kept, _cut(min_chars)(F.col(text_col), F.col(own_drops)).alias(own_cut))
    return cut.select(
        *[F.col(f"{own_cut}.text").alias(c) if c == text_col else c for c in kept],
        F.col(f"{own_cut}.n_lines").alias(lines_col),
        F.col(f"{own_cut}.n_dropped").alias(dropped_col),
    )
