"""Keyed writes as DataFrame operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Up to this many keys are broadcast: 16-40 byte ids, so tens of MB at most.
BROADCAST_KEYS = 1_000_000


def _pick(df: DataFrame, key: Sequence[str], order: Sequence[str], chooser, also=()) -> DataFrame:
    done = {name for name, _ in also}
    rest = [c for c in df.columns if c not in key and c not in done]
    picked = df.groupBy(*key).agg(
        chooser(F.struct(*rest), F.struct(*order)).alias("_row"),
        *[column.alias(name) for name, column in also],
    )
    return picked.select(
        *[F.col(c) if c in key or c in done else F.col(f"_row.{c}") for c in df.columns]
    )


def last_per_key(
    df: DataFrame, key: Sequence[str], order: Sequence[str], keep_first: Sequence[str] = ()
) -> DataFrame:
    """K2: the row with the highest position wins, as repeated upserts would leave it;
    ``keep_first`` columns stay as the first of those upserts wrote them (K4).

    ``max_by`` combines before the shuffle, so a key with a third of the log costs each
    task one row.
    """
    place = F.struct(*order)
    return _pick(df, list(key), order, F.max_by, also=tuple((c, F.min_by(c, place)) for c in keep_first))


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """K3: the row with the lowest position wins."""
    return _pick(df, list(key), order, F.min_by)


def without_existing(
    rows: DataFrame, existing: DataFrame, key: Sequence[str], broadcast_keys: int = BROADCAST_KEYS
) -> DataFrame:
    """Rows whose key is not in ``existing`` (which holds each key once).

    A small batch against a big table is the common case: its keys travel to the table,
    the hits (never more than the batch) come back, and the table is neither shuffled
    nor read beyond its key columns. A larger batch takes a plain anti-join.
    ``rows`` is counted, so callers persist it.
    """
    key = list(key)
    if rows.count() > broadcast_keys:
        return rows.join(existing.select(*key), key, "left_anti")
    hits = existing.select(*key).join(F.broadcast(rows.select(*key)), key, "left_semi")
    return rows.join(F.broadcast(hits), key, "left_anti")


# --- schema-adaptive access ---------------------------------------------------------
MANAGED_COLUMNS = {"message_id", "original_text", "model_name", "created_at"}


def adaptive_read(table: DataFrame) -> DataFrame:
    """One shape for CLI-managed and writer tables, chosen by their columns."""
    if MANAGED_COLUMNS <= set(table.columns):
        return table.select("message_id", "original_text", "model_name", "created_at", "updated_at")
    return table.select(
        F.col("id").alias("message_id"),
        F.col("text").alias("original_text"),
        F.coalesce("source", F.lit("unknown")).alias("model_name"),
        F.col("timestamp").alias("created_at"),
        F.col("timestamp").alias("updated_at"),
    )


def adaptive_rows(rows: DataFrame, target_columns: Sequence[str], dim: int, now: Column) -> DataFrame:
    """Input rows (id, text, embedding, source, timestamp, metadata) in the target's
    shape; rows without id or text are left out, unknown shapes are refused.

    A writer table's vectors are fitted to its dimension.
    """
    from ..functions.vector import fit_dimension

    columns = set(target_columns)
    usable = rows.filter("coalesce(id, '') <> '' and coalesce(text, '') <> ''")
    source = F.coalesce("source", F.lit("cli"))
    if {"message_id", "original_text", "embedding"} <= columns:
        return usable.select(
            F.col("id").alias("message_id"),
            F.col("text").alias("original_text"),
            "embedding",
            source.alias("model_name"),
            now.alias("created_at"),
            now.alias("updated_at"),
        )
    if {"id", "text", "embedding"} <= columns:
        return usable.select(
            "id",
            "text",
            fit_dimension(F.col("embedding"), dim).alias("embedding"),
            F.coalesce("timestamp", now).alias("timestamp"),
            source.alias("source"),
            F.coalesce("metadata", F.lit("{}")).alias("metadata"),
        )
    raise ValueError(f"unrecognised table columns: {sorted(columns)}")
