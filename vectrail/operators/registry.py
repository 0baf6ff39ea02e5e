"""The table registry and managed vector tables (M1-M4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fs
from ..functions.messages import good, rejected, with_reject_reason
from ..schemas import CATALOG, EMBEDDINGS, MANAGED, REGISTRY
from .keyed import adaptive_rows
from .tables import KeyedTable

# Dimension and model of a table that names none.
DEFAULT_DIMENSION = 384
DEFAULT_MODEL = "sentence-transformers/all-MiniLM-L6-v2"


def list_tables(registry: DataFrame) -> DataFrame:
    """M1."""
    return registry.orderBy("table_name")


def with_row_counts(registry: DataFrame, counts: DataFrame) -> DataFrame:
    """M4's counts for many tables at once; tables without rows count zero."""
    return registry.join(counts, "table_name", "left").withColumn(
        "row_count", F.coalesce("row_count", F.lit(0))
    )


# Shape, key, columns kept from a key's first row, and order of the rows of one key in a batch.
KINDS = {
    "managed": (MANAGED, "message_id", ["created_at"], ["updated_at", "original_text"]),
    "writer": (EMBEDDINGS, "id", [], ["timestamp", "text"]),
}


class Catalog:
    """Vector tables under one folder, described by a registry keyed by name.

    A table is ``managed`` (its vectors have the table's dimension or are refused) or a ``writer``'s
    (its vectors are padded or cut to it). The registry keeps the kind, and inserts go by it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.registry = KeyedTable(
            spark, f"{self.path}/_registry", CATALOG, key=["table_name"], keep_first=["created_at"]
        )

    def entries(self) -> DataFrame:
        """The registry; tables from before there were kinds are managed ones."""
        return self.registry.read().withColumn("kind", F.coalesce("kind", F.lit("managed")))

    def list(self) -> DataFrame:
        """M1."""
        return list_tables(self.entries().select(*REGISTRY.fieldNames()))

    def create(
        self,
        name: str,
        dimension: int = DEFAULT_DIMENSION,
        model: str = DEFAULT_MODEL,
        description: str = "",
        now: Column | None = None,
        kind: str = "managed",
    ) -> KeyedTable:
        """M2: register the table, or update its description; rows already there stay."""
        row = self.spark.range(1).select(
            F.lit(name).alias("table_name"),
            F.lit(description).alias("description"),
            F.lit(dimension).alias("vector_dimension"),
            F.lit(model).alias("model_name"),
            F.lit(kind).alias("kind"),
        )
        self.create_all(row, now)
        return self.table(name)

    def create_all(self, tables: DataFrame, now: Column | None = None) -> None:
        """M2 for many tables in one write: ``table_name``, ``description``, ``vector_dimension``,
        ``model_name``, ``kind``. A table never changes its kind, as its rows have another shape."""
        now = F.current_timestamp() if now is None else now
        there = self.entries().select("table_name", F.col("kind").alias("was"))
        odd = F.coalesce(~F.col("kind").isin(*KINDS), F.lit(True)) | (F.col("kind") != F.col("was"))
        wrong = tables.join(there, "table_name", "left").filter(odd).first()
        if wrong is not None:
            raise ValueError(f"table {wrong.table_name!r} cannot be of kind {wrong.kind!r}")
        rows = tables.withColumn("created_at", now).select(*CATALOG.fieldNames())
        self.registry.append(rows, self.registry.next_batch(), order=["created_at", "description"])

    def _entry(self, name: str) -> dict:
        entry = self.entries().filter(F.col("table_name") == name).first()
        if entry is None:
            raise KeyError(name)
        return entry.asDict()

    def _table(self, name: str, kind: str) -> KeyedTable:
        shape, key, keep_first, _ = KINDS[kind]
        return KeyedTable(self.spark, f"{self.path}/{name}", shape, key=[key], keep_first=keep_first)

    def table(self, name: str) -> KeyedTable:
        return self._table(name, self._entry(name)["kind"])

    def insert(self, name: str, rows: DataFrame, now: Column, order: list[str] | None = None) -> DataFrame:
        """Upsert rows (id, text, embedding, source, timestamp, metadata) in the table's own shape.

        Gives the rows refused, each with its ``reject_reason``: no id, no text, or a vector of
        another dimension where the table is a managed one. A writer's table pads or cuts it.
        """
        entry = self._entry(name)
        dimension, kind = entry["vector_dimension"], entry["kind"]
        checks = {
            "missing_id": F.coalesce("id", F.lit("")) == "",
            "missing_text": F.coalesce("text", F.lit("")) == "",
        }
        if kind == "managed":
            checks["wrong_dimension"] = F.col("embedding").isNotNull() & (F.size("embedding") != dimension)
        judged = with_reject_reason(rows, checks)
        shape, _, _, first_to_last = KINDS[kind]
        shaped = adaptive_rows(good(judged), shape.fieldNames(), dimension, now)
        table = self._table(name, kind)
        table.append(shaped, table.next_batch(), order=order or first_to_last)
        return rejected(judged)

    def describe(self) -> DataFrame:
        """M4 for all tables at once: the registry with ``row_count`` and ``sample_id``, the smallest id."""
        ids = None
        for r in self.entries().select("table_name", "kind").toLocalIterator():  # names only
            key = KINDS[r.kind][1]
            part = self._table(r.table_name, r.kind).read().select(F.lit(r.table_name).alias("table_name"), F.col(key).alias("id"))
            ids = part if ids is None else ids.unionByName(part)
        if ids is None:
            ids = self.spark.createDataFrame([], "table_name string, id string")
        counts = ids.groupBy("table_name").agg(F.count("*").alias("row_count"), F.min("id").alias("sample_id"))
        return with_row_counts(self.entries(), counts)

    def info(self, name: str) -> dict:
        """M4: registry entry, row count and one sample row."""
        entry = self._entry(name)
        rows = self._table(name, entry["kind"]).read()
        return {**entry, "row_count": rows.count(), "sample_data": rows.first()}

    def drop(self, name: str) -> None:
        """M3."""
        fs.remove(self.spark, f"{self.path}/{name}")
        self.registry.delete(F.col("table_name") == name)

    def drop_all(self, confirm: bool = False) -> int:
        """M3: every registered table, only when confirmed; gives their number."""
        if not confirm:
            return 0
        names = [r.table_name for r in self.registry.read().select("table_name").toLocalIterator()]
        for name in names:
            fs.remove(self.spark, f"{self.path}/{name}")
        self.registry.truncate()
        return len(names)
