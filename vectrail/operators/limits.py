"""The first rows of a table in some order, however many are asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fs import remove
from ..session import new_scratch

# Up to this many rows a top-k heap over the order columns finds the last key wanted.
HEAP_ROWS = 100_000
_ROW_BITS = (1 << 33) - 1


def first_rows(
    df: DataFrame, n: int, *order: str, skip: int = 0, heap_rows: int = HEAP_ROWS
) -> DataFrame:
    """Exactly the ``n`` rows after the first ``skip`` by the ``order`` columns, unordered.

    Rows with equal keys come in the order of a hash of the whole row, so the answer does not
    depend on ``heap_rows``. Only the order columns are ranked; the rows between the two outer
    keys are filtered where they are, so what follows runs in parallel. Up to ``heap_rows``
    the outer keys come from a heap per task, beyond it from a sort of the keys across the
    cluster. The row hash is computed for rows that tie with an outer key only.
    """
    if n <= 0:
        return df.limit(0)
    keys = df.select(*order)
    first, last = _keys_at(keys, order, [skip, skip + n], heap_rows)
    place = F.struct(*order)
    if skip and first is None:
        return df.limit(0)
    figures = keys.agg(
        *[
            F.count(F.when(test, 1)).alias(name)
            for name, key in (("first", first), ("last", last))
            if key is not None
            for name, test in ((f"{name}_below", place < key), (f"{name}_tied", place == key))
        ]
        or [F.lit(0)]
    ).first().asDict()
    begin = skip - figures["first_below"] if first is not None else 0
    end = skip + n - figures["last_below"] if last is not None else 0
    if first is not None and last is not None and keys.select(F.lit(1)).where(first == last).limit(1).count():
        return _tied(df, place == first, order, begin, end, figures["first_tied"], heap_rows)
    rows = df
    if first is not None:
        rows = rows.where(place > first)
    if last is not None:
        rows = rows.where((place <= last) if end >= figures["last_tied"] else (place < last))
    if first is not None and begin < figures["first_tied"]:
        rows = rows.unionByName(_tied(df, place == first, order, begin, figures["first_tied"], figures["first_tied"], heap_rows))
    if last is not None and end < figures["last_tied"]:
        rows = rows.unionByName(_tied(df, place == last, order, 0, end, figures["last_tied"], heap_rows))
    return rows


def _tied(df: DataFrame, same: Column, order, begin: int, end: int, total: int, heap_rows: int) -> DataFrame:
    """Rows ``begin`` to ``end`` of those with one key, in the order of the row's hash."""
    rows = df.where(same)
    if begin <= 0 and end >= total:
        return rows
    if order == ("_tie",):  # equal rows: any of them
        return rows.limit(end - begin)
    return first_rows(rows.withColumn("_tie", F.xxhash64(*df.columns)), end - begin, "_tie", skip=begin, heap_rows=heap_rows).drop("_tie")


def _keys_at(keys: DataFrame, order, positions: list[int], heap_rows: int) -> list[Column | None]:
    """The keys of the rows at these places, counted from 1; None for place 0 and past the end."""

    def literal(row) -> Column | None:
        if row is None:
            return None
        return F.struct(*[F.lit(row[c]).cast(keys.schema[c].dataType).alias(c) for c in order])

    def far(position: int):
        for part, count in counts:
            if position <= count:
                return stored.where((F.col("_part") == part) & (F.col("_row") == position - 1)).first()
            position -= count
        return None

    path = None
    if max(positions) > heap_rows:
        path = new_scratch(keys.sparkSession, "order")
        number = F.monotonically_increasing_id()
        ranked = keys.repartitionByRange(*order).sortWithinPartitions(*order)
        ranked = ranked.withColumns({"_part": F.shiftright(number, 33), "_row": number.bitwiseAND(F.lit(_ROW_BITS))})
        ranked.write.parquet(path)
        stored = keys.sparkSession.read.parquet(path)
        counts = sorted(tuple(r) for r in stored.groupBy("_part").count().collect())
    out = []
    for position in positions:
        if position <= 0:
            out.append(None)
        elif path is None:
            out.append(literal(keys.orderBy(*order).offset(position - 1).first()))
        else:
            out.append(literal(far(position)))
    if path is not None:
        remove(keys.sparkSession, path)
    return out
