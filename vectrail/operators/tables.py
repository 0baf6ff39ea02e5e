"""Keyed tables on plain parquet: an append log per micro-batch plus compacted snapshots.

    <path>/log/<n>@<batch>/           one folder per batch, each key at most once
    <path>/runs/L<level>-<m>-<n>/     the batches numbered m to n merged, sorted by key
    <path>/base/v<version>-b<n>/      snapshot covering the batches numbered up to n

Batches are numbered in order of arrival; their names tell a replay from news. A folder
counts once its job committed (``_SUCCESS``), so readers never see half a batch and a
replayed batch simply replaces its own folder. Nothing is ever read and overwritten in one
job. A table has one writer at a time.

Batches are merged by levels: eight of one level become a run of the next, so a reader meets
a number of folders that is logarithmic in the number of batches, however large the snapshot
they are still to be merged into. The newest batch stays by itself, as its stream may replay it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fs
from .keyed import first_per_key, last_per_key, without_existing

# A log of at most this many stored bytes has few enough keys to broadcast.
BROADCAST_LOG_BYTES = 16 * 1024 * 1024
NO_BATCH = -1
# Pieces of one level that make a run of the next.
FANOUT = 8
# Column that carries the batch number inside the log.
BATCH = "_batch"


@dataclass(frozen=True)
class KeyedTable:
    """``rule`` is "last" (upsert) or "first" (insert if absent).

    Under "last", columns in ``keep_first`` hold the value a key was first written with.
    ``partition_by`` columns must be part of the key.
    """

    spark: SparkSession
    path: str
    schema: T.StructType
    key: Sequence[str]
    rule: str = "last"
    keep_first: Sequence[str] = ()
    partition_by: Sequence[str] = ()
    compact_after: int = 20
    broadcast_log_bytes: int = BROADCAST_LOG_BYTES
    _columns: list[str] = field(init=False, repr=False)

    def __post_init__(self):
        if self.rule not in ("last", "first"):
            raise ValueError(f"unknown rule {self.rule!r}")
        object.__setattr__(self, "key", list(self.key))
        object.__setattr__(self, "_columns", self.schema.fieldNames())

    # --- layout ---------------------------------------------------------------------
    def _snapshots(self) -> list[tuple[int, int, str]]:
        found = []
        for name in fs.children(self.spark, f"{self.path}/base"):
            if name.startswith("v") and fs.is_committed(self.spark, f"{self.path}/base/{name}"):
                version, batch = name[1:].split("-b")
                found.append((int(version), int(batch), f"{self.path}/base/{name}"))
        return sorted(found)

    def _folders(self) -> list[tuple[int, str, str]]:
        """Number, batch name and path of every log folder, committed or not."""
        found = []
        for folder in fs.children(self.spark, f"{self.path}/log"):
            number, at, name = folder.partition("@")
            if at:
                found.append((int(number), name, f"{self.path}/log/{folder}"))
        return sorted(found)

    def _runs(self) -> list[tuple[int, int, int, str]]:
        """Level, first and last batch and path of every committed run."""
        found = []
        for name in fs.children(self.spark, f"{self.path}/runs"):
            if name.startswith("L") and fs.is_committed(self.spark, f"{self.path}/runs/{name}"):
                found.append((*map(int, name[1:].split("-")), f"{self.path}/runs/{name}"))
        return sorted(found, key=lambda run: run[1:3])

    def _pieces(self, after: int, before: int | None = None) -> list[tuple[int, int, int, str]]:
        """Level, first and last batch and path of what holds the batches after a snapshot, oldest first."""
        runs = [r for r in self._runs() if r[1] > after]
        outer = [r for r in runs if not any(o is not r and o[1] <= r[1] and r[2] <= o[2] for o in runs)]
        single = [
            (0, number, number, path)
            for number, _, path in self._folders()
            if number > after and not any(r[1] <= number <= r[2] for r in outer) and fs.is_committed(self.spark, path)
        ]
        found = sorted(outer + single, key=lambda piece: piece[1])
        return [piece for piece in found if before is None or piece[2] < before]

    def _is_final(self, number: int) -> bool:
        """True for a batch that is part of a snapshot or a run; writing it again changes nothing."""
        return number <= self._covered() or any(r[1] <= number <= r[2] for r in self._runs())

    def _read(self, paths: Sequence[str], with_batch: bool = False) -> DataFrame:
        position = [T.StructField(BATCH, T.LongType())] if with_batch else []
        schema = T.StructType(self.schema.fields + position)
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths).select(*schema.fieldNames())

    # --- reading --------------------------------------------------------------------
    def read(self, before: str | int | None = None) -> DataFrame:
        """The table's rows, one per key; ``before`` names a batch and leaves out its rows
        and later ones, as a replay of that batch needs."""
        number = None if before is None else self._number(str(before))
        return self._rows(None if number is None or self._is_final(number) else number)

    def _rows(self, before: int | None) -> DataFrame:
        snapshots = self._snapshots()
        upto, base = NO_BATCH, None
        if snapshots:
            _, upto, base_path = snapshots[-1]
            base = self._read([base_path])
        paths = [piece[3] for piece in self._pieces(upto, before)]
        if not paths:
            return base if base is not None else self._read([])
        log = self._read(paths, with_batch=True)
        if self.rule == "first":
            log = log.drop(BATCH)
            return log if base is None else base.unionByName(log)
        newest = self._newest(log).drop(BATCH)
        if base is None:
            return newest
        keys = newest.select(*self.key)
        stored = sum(fs.size_bytes(self.spark, p) for p in paths)
        if stored <= self.broadcast_log_bytes:
            keys = F.broadcast(keys)
        if self.keep_first:
            newest = self._with_kept(newest, base)
        return base.join(keys, self.key, "left_anti").unionByName(newest)

    def _newest(self, log: DataFrame) -> DataFrame:
        """The newest row of every key, with its batch.

        Only keys written more than once are gathered, with their newest batch; rows go by that
        list where they are, and their payloads are not aggregated.
        """
        again = log.groupBy(*[F.col(k).alias(f"_again_{k}") for k in self.key]).agg(
            F.max(BATCH).alias("_newest"), F.count("*").alias("_times"),
            *[F.min_by(c, BATCH).alias(f"_first_{c}") for c in self.keep_first],
        ).filter("_times > 1")
        same = [F.col(k).eqNullSafe(F.col(f"_again_{k}")) for k in self.key]
        rows = log.join(again, reduce(lambda a, b: a & b, same), "left")
        rows = rows.filter(F.col("_newest").isNull() | (F.col(BATCH) == F.col("_newest")))
        kept = [
            F.when(F.col("_newest").isNull(), F.col(c)).otherwise(F.col(f"_first_{c}")).alias(c) if c in self.keep_first else F.col(c)
            for c in self._columns
        ]
        return rows.select(*kept, BATCH)

    def _with_kept(self, newest: DataFrame, base: DataFrame) -> DataFrame:
        old = base.select(*self.key, *[F.col(c).alias(f"_old_{c}") for c in self.keep_first])
        return newest.join(old, self.key, "left").select(
            *[
                F.coalesce(f"_old_{c}", c).alias(c) if c in self.keep_first else F.col(c)
                for c in self._columns
            ]
        )

    # --- writing --------------------------------------------------------------------
    def _number(self, name: str) -> int:
        """A known batch keeps its number, a new one comes after all others."""
        folders = self._folders()
        for number, known, _ in folders:
            if known == name:
                return number
        return max([self._covered(), *[number for number, _, _ in folders]]) + 1

    def append(self, rows: DataFrame, batch: str | int, order: Sequence[str], known_new: bool = False) -> None:
        """Write one batch; ``order`` columns rank rows of a key inside the batch.

        Appending a batch of the same name again leaves the table as it was. ``known_new`` tells a
        "first" table that the caller has left out all keys it holds already.
        """
        number = self._number(str(batch))
        if self._is_final(number):
            return
        path = f"{self.path}/log/{number:09d}@{batch}"
        if self.rule == "first" and known_new:
            self._write(first_per_key(rows, self.key, order), path, number)
        elif self.rule == "first":
            picked = first_per_key(rows, self.key, order).persist()
            try:
                self._write(without_existing(picked, self._rows(number), self.key), path, number)
            finally:
                picked.unpersist()
        else:
            self._write(last_per_key(rows, self.key, order, self.keep_first), path, number)
        if number - self._covered() >= self.compact_after and self._log_is_heavy():
            self.compact()
        else:
            self._merge_levels()

    def _merge_levels(self) -> None:
        """Merge the oldest pieces of a level once there are enough; the newest batch is left out."""
        while True:
            pieces = self._pieces(self._covered())[:-1]
            levels = sorted({p[0] for p in pieces})
            full = next((level for level in levels if sum(p[0] == level for p in pieces) >= FANOUT), None)
            if full is None:
                return
            parts = [p for p in pieces if p[0] == full][:FANOUT]
            log = self._read([p[3] for p in parts], with_batch=True)
            merged = log if self.rule == "first" else self._newest(log)
            merged = merged.repartitionByRange(*self.key).sortWithinPartitions(*self.key)
            self._write(merged, f"{self.path}/runs/L{full + 1}-{parts[0][1]:09d}-{parts[-1][2]:09d}", with_batch=True)

    def _write(self, rows: DataFrame, path: str, number: int | None = None, with_batch: bool = False) -> None:
        rows = rows.select(*self._columns, *([BATCH] if with_batch else []))
        if number is not None:
            rows = rows.withColumn(BATCH, F.lit(number).cast("bigint"))
        writer = rows.write.mode("overwrite")
        if self.partition_by:
            writer = writer.partitionBy(*self.partition_by)
        writer.parquet(path)

    def _covered(self) -> int:
        snapshots = self._snapshots()
        return snapshots[-1][1] if snapshots else NO_BATCH

    def _log_is_heavy(self) -> bool:
        """Rewriting the snapshot pays once the log reaches a quarter of it."""
        snapshots = self._snapshots()
        if not snapshots:
            return True
        _, upto, base = snapshots[-1]
        log = sum(fs.size_bytes(self.spark, p[3]) for p in self._pieces(upto))
        return log * 4 >= fs.size_bytes(self.spark, base)

    def next_batch(self) -> int:
        """A fresh batch name, for writers outside a stream."""
        return max([self._covered(), *[number for number, _, _ in self._folders()]]) + 1

    def replace(self, rows: DataFrame) -> None:
        """Make ``rows`` the table's content, as a new snapshot sorted by key.

        Range partitioning gives files disjoint key ranges, so a lookup by key skips all
        but one of them.
        """
        snapshots = self._snapshots()
        version = snapshots[-1][0] + 1 if snapshots else 0
        sorted_rows = rows.repartitionByRange(*self.key).sortWithinPartitions(*self.key)
        self._write(sorted_rows, f"{self.path}/base/v{version:06d}-b{self.next_batch() - 1}")

    def compact(self) -> None:
        self.replace(self.read())

    def delete(self, condition) -> None:
        """Drop the rows that meet ``condition``."""
        self.replace(self.read().filter(~F.coalesce(condition, F.lit(False))))

    def truncate(self) -> None:
        """K8: empty the table."""
        self.replace(self._read([]))

    def vacuum(self) -> None:
        """Delete folders that the newest snapshot or a run made redundant; run it when no reader
        still works on an older one.

        The last batch of each stream stays, as the stream may replay it.
        """
        snapshots = self._snapshots()
        for _, _, path in snapshots[:-1]:
            fs.remove(self.spark, path)
        folders, covered = self._folders(), self._covered()
        used = {piece[3] for piece in self._pieces(covered)}
        last = {name.rpartition(".")[0]: number for number, name, _ in folders if "." in name}
        for number, name, path in folders:
            if self._is_final(number) and last.get(name.rpartition(".")[0]) != number:
                fs.remove(self.spark, path)
        for *_, path in self._runs():
            if path not in used:
                fs.remove(self.spark, path)


def routed_table(spark: SparkSession, path: str, schema: T.StructType) -> KeyedTable:
    """K5: many destinations in one store, keyed by destination and id. A destination
    exists from its first row on and is read by pruning to its folder."""
    return KeyedTable(
        spark,
        path,
        T.StructType(schema.fields + [T.StructField("table_name", T.StringType())]),
        key=("table_name", "id"),
        partition_by=("table_name",),
    )
