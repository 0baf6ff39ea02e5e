"""Reading and searching tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.vector import cosine_distance, literal
from ..session import new_scratch
from .limits import HEAP_ROWS, first_rows

# Distances are compared at this many digits, ties fall to the id.
DIGITS = 6
# About as many bytes of vectors lie in a share of the rows, and in a block of the queries.
BLOCK_BYTES = 16 * 1024 * 1024
# Shares of small tables have at least this many rows.
LEAST_SHARE = 1024
# Distances that a task holds at once.
SCORES = 4 * 1024 * 1024


def newest(
    df: DataFrame, by: str, id: str, limit: int, offset: int = 0, heap_rows: int = HEAP_ROWS
) -> DataFrame:
    """L1: newest first by a time column; a per-task top-k, and for pages too deep for one
    a cut by key."""
    age = F.coalesce(-F.unix_micros(by), F.lit(2**63 - 1))
    if offset + limit <= heap_rows:
        # Rows of one time and id come in the order that the deep way gives them.
        ordered = df.orderBy(F.col(by).desc(), F.col(id), F.xxhash64(*df.columns, age))
        return (ordered.offset(offset) if offset else ordered).limit(limit)
    page = first_rows(
        df.withColumn("_age", age), limit, "_age", id, skip=offset, heap_rows=heap_rows
    )
    return page.orderBy("_age", id).drop("_age")


def paginate(
    df: DataFrame, by: str, id: str, limit: int = 100, offset: int = 0
) -> tuple[DataFrame, int]:
    """L2: one page, newest first, and the total number of rows."""
    return newest(df, by, id, limit, offset), df.count()


def search_text(df: DataFrame, query: str, text: str, by: str, id: str, limit: int = 10) -> DataFrame:
    """case-insensitive containment, newest first; ``%`` and ``_`` act as wildcards."""
    return newest(df.filter(F.col(text).ilike(f"%{query}%")), by, id, limit)


def get_by_id(df: DataFrame, value, id: str = "id") -> DataFrame:
    """the row with this id; the predicate reaches the parquet scan."""
    return df.filter(F.col(id) == value)


def recent(df: DataFrame, now: Column, interval: str, at: str = "processed_at") -> DataFrame:
    """rows younger than an interval such as ``1 hour``."""
    return df.filter(F.col(at) > now - F.expr(f"INTERVAL {interval}"))


def search_recent(df: DataFrame, by: str, id: str, k: int = 10) -> DataFrame:
    """The newest rows at a constant distance."""
    return newest(df, by, id, k).withColumn("distance", F.lit(0.5))


def with_distance(df: DataFrame, query: Sequence[float], vector: str = "embedding") -> DataFrame:
    length = math.sqrt(sum(float(x) * float(x) for x in query))
    return df.withColumn("distance", cosine_distance(F.col(vector), literal(query), F.lit(length)))


def top_k(
    df: DataFrame, query: Sequence[float], k: int, id: str, vector: str = "embedding"
) -> DataFrame:
    """L4: the exact k nearest rows by cosine distance; undefined distances come last.

    Rows without a vector, or with one of another length, are left out. One pass; each
    task keeps k rows.
    """
    scored = with_distance(df.filter(F.size(vector) == len(query)), query, vector).drop(vector)
    return scored.orderBy(F.round("distance", DIGITS).asc_nulls_last(), F.col(id)).limit(k)


def vectors_of(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _nearest(distance: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest distances, equal ones by position."""
    near = np.arange(len(distance))
    if len(distance) > k:
        near = np.flatnonzero(distance <= np.partition(distance, k - 1)[k - 1])
    return near[np.argsort(distance[near], kind="stable")[:k]]


def _scored(k: int):
    """The k nearest rows of one share for every query of one block; an undefined distance is null."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        query_ids, found = asked.column("query_id"), []
        ids, distances = rows.column("id"), [np.empty(0)]
        if asked.num_rows and rows.num_rows:
            rows = rows.take(pc.sort_indices(ids, null_placement="at_start"))  # equal distances go to the smaller id
            ids, data = rows.column("id"), vectors_of(rows.column("vector").combine_chunks())
            matrix = vectors_of(asked.column("asked").combine_chunks())
            norms, lengths = (np.sqrt((m * m).sum(axis=1)) for m in (data, matrix))
            step = max(1, SCORES // len(data))
            for begin in range(0, len(matrix), step):
                part = slice(begin, begin + step)
                scale = np.outer(lengths[part], norms)
                with np.errstate(divide="ignore", invalid="ignore"):
                    block = np.round(1.0 - (matrix[part] @ data.T) / scale, DIGITS)
                block[~np.isfinite(block)] = np.inf
                for q, distance in enumerate(block, start=begin):
                    near = _nearest(distance, k)
                    found.append((np.full(len(near), q), near))
                    distances.append(distance[near])
        at, near = (np.concatenate([f[i] for f in found] or [np.empty(0, int)]) for i in (0, 1))
        distance = np.concatenate(distances)
        return pa.table(
            [query_ids.take(pa.array(at, pa.int64())), ids.take(pa.array(near, pa.int64())), pa.array(distance, mask=np.isinf(distance))],
            names=["query_id", "id", "distance"],
        )

    return run


def top_k_many(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    query_id: str,
    id: str,
    query_vector: str = "embedding",
    vector: str = "embedding",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """L4 for many queries: (query_id, id, distance, rank), exact.

    Queries are stored once and dealt into blocks, the rows into shares, both by a hash and both of
    about ``block_bytes``. A task scores one share against one block and passes on k rows per query;
    each task keeps k rows per query before the last merge. So no pairs are written, no vector passes
    the driver, and rows and queries are evaluated once each, whatever their number (rows are also
    counted). A row is moved once per block of queries of its length, a query once per share.

    A query meets the rows whose vector is as long as its own. A null or empty query vector has no
    neighbours; distances that are undefined (a zero vector, an entry that is no number) come last, as null.
    """
    spark = queries.sparkSession
    held = new_scratch(spark, "topk-queries")
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).cast("array<double>").alias("asked"))
    asked.filter(F.size("asked") > 0).write.parquet(held)
    asked = spark.read.schema(asked.schema).parquet(held).withColumn("dim", F.size("asked"))
    total, tasks = corpus.count(), spark.sparkContext.defaultParallelism
    kinds = []  # one row per vector length
    for n, size in asked.groupBy("dim").agg(F.count("*")).collect():
        each = max(1, block_bytes // (8 * n))
        shares = max(-(-total // each), min(tasks, -(-total // LEAST_SHARE)), 1)
        kinds.append((n, shares, max(1, -(-size // each))))
    kinds = F.broadcast(spark.createDataFrame(kinds, "dim int, shares int, blocks int"))

    def dealt(column: str, parts: str) -> Column:
        return F.pmod(F.xxhash64(*column.split()), F.col(parts)).cast("int")

    def every(parts: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))

    asked = asked.join(kinds, "dim").withColumn("block", dealt("query_id asked", "blocks")).withColumn("share", every("shares"))
    rows = corpus.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.withColumn("dim", F.size("vector")).join(kinds, "dim")
    rows = rows.withColumn("share", dealt("id vector", "shares")).withColumn("block", every("blocks"))
    unit = ["dim", "share", "block"]
    asked, rows = asked.select("query_id", "asked", *unit), rows.select("id", "vector", *unit)
    types = [queries.schema[query_id].dataType, corpus.schema[id].dataType, T.DoubleType()]
    found = T.StructType([T.StructField(n, t) for n, t in zip(("query_id", "id", "distance"), types)])
    near = asked.groupBy(*unit).cogroup(rows.groupBy(*unit)).applyInArrow(_scored(k), found)
    order = Window.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), F.col("id"))
    near = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return near.withColumnRenamed("id", id)
