"""Approximate search over clustered vectors that are kept on disk and grow.

    <path>/lists/v<version>/           one row per list: centre, rows, the generations that hold it
    <path>/rows/<generation>/list_id=  the vectors, as one write left them

A version counts once committed (``_SUCCESS``), and a generation once a version names it, so an index
is opened again from its folder alone and a failed write changes nothing. An index has one writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import fs
from ..functions.vector import norm
from .search import DIGITS, top_k, vectors_of

DEFAULT_LISTS = 100
# Rows per list that the centres are learnt from, on the average.
TRAIN_ROWS = 1024
# All centres together are sent to every task; an index of more is refused.
CENTRE_BYTES = 256 * 1024 * 1024
# Generations of one level that are merged into one of the next.
FANOUT = 4
# A list of more than this many times the mean is split.
CROWDED = 4.0
# Rows and queries of a list that one task scores together.
SHARE_ROWS = 8192
BLOCK_QUERIES = 1024


def _unit(matrix: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(matrix, axis=-1, keepdims=True)
    return matrix / np.where(length == 0, 1, length)


def with_lists(df: DataFrame, vector: str, ids: np.ndarray, centers: np.ndarray, probes: int = 1) -> DataFrame:
    """``df`` with ``list_ids``: the ``probes`` nearest lists by cosine, nearest first. Vectors must have the centres' length."""
    if centers.nbytes > CENTRE_BYTES:
        raise ValueError(f"{len(ids)} centres take {centers.nbytes} bytes, more than the {CENTRE_BYTES} a task may be sent")
    held = df.sparkSession.sparkContext.broadcast((ids, _unit(centers)))
    schema = T.StructType([*df.schema.fields, T.StructField("list_ids", T.ArrayType(T.IntegerType()))])
    width = min(probes, len(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, centers = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            near = np.argsort(-(vectors_of(batch.column(vector)) @ centers.T), axis=1, kind="stable")[:, :width]
            flat = pa.array(ids[near].ravel().astype(np.int32))
            found = pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, width), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "list_ids"])

    return df.mapInArrow(run, schema)


@dataclass(frozen=True)
class ClusteredIndex:
    """One version of an index; writing gives the next one and leaves this one readable.

    The centres are lists x dimension numbers, whatever the table's size.
    """

    spark: SparkSession
    path: str
    version: int
    id: str
    vector: str
    list_ids: np.ndarray
    centers: np.ndarray
    counts: dict[int, int]
    generations: dict[int, tuple[str, ...]]
    batches: tuple[str, ...]
    schema: T.StructType

    # --- reading --------------------------------------------------------------------
    def nearest_lists(self, query: Sequence[float], probes: int) -> list[int]:
        similarity = _unit(self.centers) @ np.asarray(query, dtype=np.float64)
        return [int(self.list_ids[i]) for i in np.argsort(-similarity, kind="stable")[:probes]]

    def rows(self, lists: Sequence[int] | None = None) -> DataFrame:
        """Rows of some or all lists with their ``list_id``; no other list's folder is read."""
        wanted = self.counts if lists is None else lists
        schema = T.StructType([*self.schema.fields, T.StructField("list_id", T.IntegerType())])
        parts: dict[str, list[int]] = {}  # a list that moved on left stale rows in generations that no longer count it
        for n in sorted(wanted):
            for generation in self.generations[n]:
                parts.setdefault(generation, []).append(n)
        if not parts:
            return self.spark.createDataFrame([], schema)
        out = None
        for generation, members in sorted(parts.items()):
            part = self.spark.read.schema(schema).parquet(f"{self.path}/rows/{generation}")
            part = part.filter(F.col("list_id").isin(members)).select(*schema.fieldNames())
            out = part if out is None else out.unionByName(part)
        return out

    def search(self, query: Sequence[float], k: int, probes: int = 10) -> DataFrame:
        """The k nearest rows of the ``probes`` nearest lists; other folders are not read."""
        return top_k(self.rows(self.nearest_lists(query, probes)).drop("list_id"), query, k, self.id, self.vector)

    def search_many(
        self, queries: DataFrame, k: int, query_id: str, query_vector: str = "embedding", probes: int = 10,
        share_rows: int = SHARE_ROWS, block_queries: int = BLOCK_QUERIES,
    ) -> DataFrame:
        """(query_id, id, distance, rank): for every query the k nearest rows of its ``probes`` nearest lists.

        A join of queries and rows on the list. A list's rows are dealt into shares and its queries into
        blocks of bounded size; every task scores one share against one block and passes on k rows per
        query, so a crowded or much asked list is many tasks and no pairs are written. With ``probes``
        as many as there are lists the answer is exact. Null, zero and otherwise long query vectors
        have no neighbours.
        """
        dim = self.centers.shape[1]
        usable = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).cast("array<double>").alias("asked"))
        usable = usable.filter((F.size("asked") == dim) & (norm(F.col("asked")) > 0))
        asked = with_lists(usable, "asked", self.list_ids, self.centers, probes)
        asked = asked.select("query_id", "asked", F.explode("list_ids").alias("list_id"))
        most = queries.count()  # no list is asked by more
        blocks = max(1, -(-most // block_queries))
        shares = F.create_map(*[F.lit(x) for n, size in self.counts.items() for x in (n, max(1, -(-size // share_rows)))])
        dealt = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        dealt = dealt.withColumn("share", F.explode(F.sequence(F.lit(0), shares[F.col("list_id")] - 1)))
        rows = self.rows().select(F.col(self.id).alias("id"), F.col(self.vector).cast("array<double>").alias("vector"), "list_id")
        rows = rows.withColumn("share", F.pmod(F.xxhash64("id"), shares[F.col("list_id")]).cast("int"))
        rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        unit = ["list_id", "share", "block"]
        types = [queries.schema[query_id].dataType, self.schema[self.id].dataType, T.DoubleType()]
        found = T.StructType([T.StructField(n, t) for n, t in zip(("query_id", "id", "distance"), types)])
        near = dealt.groupBy(*unit).cogroup(rows.groupBy(*unit)).applyInArrow(_scored(k), found)
        order = Window.partitionBy("query_id").orderBy("distance", "id")
        near = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return near.withColumnRenamed("id", self.id)

    # --- writing --------------------------------------------------------------------
    def add(self, df: DataFrame, batch: str | int | None = None) -> ClusteredIndex:
        """The next version, with the rows of ``df`` in their nearest lists.

        Ids are taken to be new. A batch of a name seen before changes nothing, so a replayed one
        does no harm. Generations are merged by levels and crowded lists split on the way.
        """
        if batch is not None and str(batch) in self.batches:
            return self
        rows = _usable(df, self.vector, self.centers.shape[1]).select(*self.schema.fieldNames())
        assigned = with_lists(rows, self.vector, self.list_ids, self.centers)
        name = f"L0-{self.version + 1:09d}"
        counts = self._write(assigned.withColumn("list_id", F.get("list_ids", 0)).drop("list_ids"), name)
        totals = {n: size + counts.get(n, 0) for n, size in self.counts.items()}
        held = {n: (*g, name) if n in counts else g for n, g in self.generations.items()}
        batches = self.batches if batch is None else (*self.batches, str(batch))
        after = _commit(self, self.version + 1, self.list_ids, self.centers, totals, held, batches)
        return after._merged().split_crowded()

    def _write(self, rows: DataFrame, name: str) -> dict[int, int]:
        """Write a generation and count its lists; a crowded list is many files of one folder."""
        path = f"{self.path}/rows/{name}"
        rows.sortWithinPartitions("list_id").write.mode("overwrite").partitionBy("list_id").parquet(path)
        if not any(x.startswith("list_id=") for x in fs.children(self.spark, path)):
            return {}
        return {r.list_id: r.n for r in self.spark.read.parquet(path).groupBy("list_id").agg(F.count("*").alias("n")).collect()}

    def _merged(self) -> ClusteredIndex:
        """FANOUT generations of one level become one of the next, so their number stays logarithmic."""
        live = sorted({g for names in self.generations.values() for g in names})
        for level in sorted({g.split("-")[0] for g in live}, key=lambda x: int(x[1:])):
            old = [g for g in live if g.startswith(f"{level}-")]
            if len(old) >= FANOUT:
                name = f"L{int(level[1:]) + 1}-{self.version + 1:09d}"
                moved = {n: tuple(g for g in names if g in old) for n, names in self.generations.items()}
                moved = {n: names for n, names in moved.items() if names}
                part = ClusteredIndex(**(vars(self) | {"generations": moved}))
                self._write(part.rows(list(moved)), name)
                held = {n: tuple(g for g in names if g not in old) + ((name,) if n in moved else ()) for n, names in self.generations.items()}
                after = _commit(self, self.version + 1, self.list_ids, self.centers, self.counts, held, self.batches)
                return after._merged()
        return self

    def split_crowded(self, factor: float = CROWDED, seed: int = 42) -> ClusteredIndex:
        """The next version, in which lists of more than ``factor`` times the mean are two or more lists.

        New centres come from at most about ``TRAIN_ROWS`` rows per new list, chosen by a hash of the id.
        """
        mean = sum(self.counts.values()) / max(1, len(self.counts))
        parts = {n: int(min(16, max(2, round(size / mean)))) for n, size in self.counts.items() if mean and size > factor * mean}
        if not parts:
            return self
        crowded = self.rows(sorted(parts))
        share = F.create_map(*[F.lit(x) for n, m in parts.items() for x in (n, m * TRAIN_ROWS / self.counts[n])])
        chance = F.pmod(F.xxhash64(F.col(self.id), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        sample = crowded.filter(chance < share[F.col("list_id")]).select("list_id", F.col(self.vector).cast("array<double>").alias("v"))
        fresh = T.StructType([T.StructField("list_id", T.IntegerType()), T.StructField("centre", T.ArrayType(T.DoubleType()))])
        found: dict[int, list] = {}
        for r in sample.groupBy("list_id").applyInArrow(_subcentres(parts, seed), fresh).collect():
            found.setdefault(r.list_id, []).append(r.centre)
        found = {n: c for n, c in found.items() if len(c) > 1}  # copies of one vector cannot be split
        if not found:
            return self
        old = list(found)
        centers = np.array([c for n in old for c in found[n]])
        ids = np.arange(len(centers)) + int(self.list_ids.max()) + 1
        moving = self.rows(old).drop("list_id")
        assigned = with_lists(moving, self.vector, ids, centers).withColumn("list_id", F.get("list_ids", 0)).drop("list_ids")
        name = f"L1-{self.version + 1:09d}"
        counts = self._write(assigned, name)
        stay = ~np.isin(self.list_ids, old)
        totals = {n: size for n, size in self.counts.items() if n not in found} | {int(n): counts.get(int(n), 0) for n in ids}
        held = {n: g for n, g in self.generations.items() if n not in found} | {int(n): (name,) if int(n) in counts else () for n in ids}
        return _commit(
            self, self.version + 1, np.concatenate((self.list_ids[stay], ids)), np.concatenate((self.centers[stay], centers)), totals, held, self.batches
        )

    def vacuum(self) -> None:
        """Delete generations and versions that this one does not name; run it when no reader still works on an older one."""
        live = {g for names in self.generations.values() for g in names}
        for name in fs.children(self.spark, f"{self.path}/rows"):
            if name not in live:
                fs.remove(self.spark, f"{self.path}/rows/{name}")
        for name in fs.children(self.spark, f"{self.path}/lists"):
            if name != f"v{self.version:09d}":
                fs.remove(self.spark, f"{self.path}/lists/{name}")


def _usable(df: DataFrame, vector: str, dim: int | None = None) -> DataFrame:
    usable = df.filter(norm(F.col(vector)) > 0)
    return usable if dim is None else usable.filter(F.size(vector) == dim)


def _subcentres(parts: dict[int, int], seed: int):
    """Centres of one crowded list from its bounded sample, by a few rounds of spherical k-means."""

    def run(table: pa.Table) -> pa.Table:
        n = table.column("list_id")[0].as_py()
        v = np.unique(_unit(vectors_of(table.column("v").combine_chunks())), axis=0)
        rng = np.random.default_rng(seed)
        centres = v[rng.choice(len(v), min(parts[n], len(v)), replace=False)]
        for _ in range(10):
            own = np.argmax(v @ centres.T, axis=1)
            centres = np.array([_unit(v[own == j].sum(axis=0)) if (own == j).any() else centres[j] for j in range(len(centres))])
        kinds = [pa.array([n] * len(centres), pa.int32()), pa.array(centres.tolist(), pa.list_(pa.float64()))]
        return pa.table(kinds, names=["list_id", "centre"])

    return run


def _scored(k: int):
    """The k nearest rows of one share for every query of one block."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        query_ids, ids, distances = asked.column("query_id"), rows.column("id"), []
        at, rank = [], []
        if len(query_ids) and len(ids):
            scores = 1.0 - _unit(vectors_of(asked.column("asked").combine_chunks())) @ _unit(vectors_of(rows.column("vector").combine_chunks())).T
            scores = np.round(scores, DIGITS)
            order = np.argsort(ids.to_numpy(), kind="stable")  # equal distances go to the smaller id
            for q, found in enumerate(scores[:, order]):
                near = np.argsort(found, kind="stable")[:k]
                at += [q] * len(near)
                rank += order[near].tolist()
                distances += found[near].tolist()
        return pa.table(
            [query_ids.take(pa.array(at, pa.int64())), ids.take(pa.array(rank, pa.int64())), pa.array(distances, pa.float64())],
            names=["query_id", "id", "distance"],
        )

    return run


def _commit(base: ClusteredIndex, version, list_ids, centers, counts, generations, batches) -> ClusteredIndex:
    """Write a version; it is small (lists x dimension) and replaces nothing."""
    spark, path = base.spark, base.path
    rows = [
        (int(n), [float(x) for x in c], int(counts.get(int(n), 0)), list(generations.get(int(n), ())), base.id, base.vector, list(batches), base.schema.json())
        for n, c in zip(list_ids, centers)
    ]
    spark.createDataFrame(rows, _LISTS).coalesce(1).write.mode("overwrite").parquet(f"{path}/lists/v{version:09d}")
    held = {int(n): tuple(generations.get(int(n), ())) for n in list_ids}
    sizes = {int(n): int(counts.get(int(n), 0)) for n in list_ids}
    return ClusteredIndex(spark, path, version, base.id, base.vector, np.asarray(list_ids), np.asarray(centers), sizes, held, tuple(batches), base.schema)


_LISTS = "list_id int, centre array<double>, n_rows long, generations array<string>, id string, vector string, batches array<string>, schema string"


def open_index(spark: SparkSession, path: str) -> ClusteredIndex:
    """The newest committed version of the index in a folder."""
    versions = [v for v in fs.children(spark, f"{path}/lists") if fs.is_committed(spark, f"{path}/lists/{v}")]
    if not versions:
        raise FileNotFoundError(f"no index in {path}")
    rows = sorted(spark.read.parquet(f"{path}/lists/{versions[-1]}").collect(), key=lambda r: r.list_id)
    schema = T.StructType.fromJson(json.loads(rows[0].schema))
    return ClusteredIndex(
        spark, path, int(versions[-1][1:]), rows[0].id, rows[0].vector, np.array([r.list_id for r in rows]), np.array([r.centre for r in rows]),
        {r.list_id: r.n_rows for r in rows}, {r.list_id: tuple(r.generations) for r in rows}, tuple(rows[0].batches), schema,
    )


def build_index(
    df: DataFrame,
    path: str,
    id: str,
    vector: str = "embedding",
    lists: int = DEFAULT_LISTS,
    seed: int = 42,
    train_rows: int = TRAIN_ROWS,
    iterations: int = 10,
) -> ClusteredIndex:
    """Cluster by cosine, assign every vector and store the rows by list; an index in ``path`` is replaced.

    Zero and null vectors have no cosine distance and stay out of the index, as do vectors of another
    length than the most frequent. The centres are learnt from about ``train_rows`` vectors per list,
    chosen by a hash of the id; every vector is indexed.
    """
    spark = df.sparkSession
    usable = _usable(df, vector)
    sizes = usable.groupBy(F.size(vector).alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        raise ValueError("no vector to index")
    usable = usable.filter(F.size(vector) == sizes[0].dim)
    chance = F.pmod(F.xxhash64(F.col(id), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    training = usable.filter(chance < lists * train_rows / sizes[0].n)
    points = training.select(array_to_vector(F.col(vector).cast("array<double>")).alias("point"))
    model = KMeans(k=lists, distanceMeasure="cosine", seed=seed, maxIter=iterations, featuresCol="point", predictionCol="list_id").fit(points)
    centers = np.array(model.clusterCenters())
    versions = fs.children(spark, f"{path}/lists")
    version = int(versions[-1][1:]) + 1 if versions else 0
    start = ClusteredIndex(spark, path, version, id, vector, np.arange(len(centers)), centers, {}, {}, (), df.schema)
    assigned = with_lists(usable, vector, start.list_ids, centers).withColumn("list_id", F.get("list_ids", 0)).drop("list_ids")
    name = f"L1-{version:09d}"
    counts = start._write(assigned, name)
    return _commit(start, version, start.list_ids, centers, counts, {n: (name,) for n in counts}, ())
