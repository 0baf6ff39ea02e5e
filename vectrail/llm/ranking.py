"""Weighted list ranking: how much every element of a linked list weighs together with all before it.

A table holds one row per element with its successor. Every task first joins up the runs of elements
that lie in its own key range; the runs left are halved by random mate rounds (an element that drew 0
swallows a successor that drew 1) until a fixed number is left, which one task walks. The rounds are
then undone in reverse. Sizes fall geometrically, so all rounds together move a few times the first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, stored

KEY, NEXT = ["c", "s"], ["nc", "ns"]
PER_TASK = 1 << 18  # elements that a task joins up in memory
LAST = 1 << 16  # runs that one task walks


def _ddl(names: list[str]) -> str:
    return ", ".join(f"{n} long" for n in names)


def _runs(weights: list[str]):
    """Elements of one task with the first element of their run and the weights from there on; the run's last keeps the successor."""

    def walk(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        keys = list(zip(*(table.column(k).to_pylist() for k in KEY)))
        place = {k: i for i, k in enumerate(keys)}
        after = [place.get(k, -1) for k in zip(*(table.column(k).to_pylist() for k in NEXT))]
        first = np.ones(len(keys), bool)
        first[[i for i in after if i >= 0]] = False
        order, heads, starts = [], [], []
        for head in np.flatnonzero(first).tolist():
            starts.append(len(order))
            i = head
            while i >= 0:
                order.append(i), heads.append(head)
                i = after[i]
        sizes = np.diff([*starts, len(order)])
        out = table.take(pa.array(order))
        head_keys = [pa.array([keys[h][k] for h in heads], pa.int64()) for k in (0, 1)]
        last = np.zeros(len(order), bool)
        last[np.cumsum(sizes) - 1] = True
        sums = []
        for w in weights:
            values = out.column(w).to_numpy()
            total = np.cumsum(values)
            sums.append(pa.array(total - np.repeat((total - values)[starts], sizes), pa.int64()))
        columns = [out.column("c"), out.column("s"), *head_keys, out.column("nc"), out.column("ns"), *sums, pa.array(last)]
        yield from pa.table(columns, names=[*KEY, "hc", "hs", *NEXT, *weights, "last"]).combine_chunks().to_batches(1 << 16)

    return walk


def _ahead(weights: list[str]):
    """What weighs before every run, for runs that one task holds."""

    def walk(batches):
        for batch in _runs(weights)(batches):
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in [*KEY, *weights]], names=[*KEY, *weights])

    return walk


def rank_list(links: DataFrame, weights: list[str], per_task: int = PER_TASK, last: int = LAST) -> DataFrame:
    """``c, s`` of every element, and for every weight its sum over all elements up to and with it.

    ``links`` has long columns ``c, s`` (an element's key, unique), ``nc, ns`` (its successor's, null at
    the end of a list) and ``weights``. A few lists are ranked each for itself; their last runs are walked in
    one task. The lists must have no cycle. No rows give no rows.
    """
    links = stored(links.select(*KEY, *NEXT, *weights), "links")
    tasks = max(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-links.count() // per_task))
    ddl = _ddl([*KEY, "hc", "hs", *NEXT, *weights]) + ", last boolean"
    runs = stored(links.repartitionByRange(tasks, *KEY).mapInArrow(_runs(weights), ddl), "runs")
    discard(links)
    level = runs.where("last").select(F.col("hc").alias("c"), F.col("hs").alias("s"), *NEXT, *weights)
    rounds: list[DataFrame] = []
    while level.where("nc is not null").count() > last:
        rounds.append(stored(_halved(level, weights, len(rounds)), "mated"))
        level = rounds[-1].select(*KEY, *NEXT, *weights)
    out = level.repartition(1).mapInArrow(_ahead(weights), _ddl([*KEY, *weights]))
    own = [F.col(f"own.{w}").alias(f"own_{w}") for w in weights]
    out = out.alias("sum").join(level.alias("own"), KEY).select(*KEY, *[F.col(f"sum.{w}") for w in weights], *own)
    ranks = stored(out.select(*KEY, *[(F.col(w) - F.col(f"own_{w}")).alias(w) for w in weights]), "ranks")
    for done in reversed(rounds):
        gone = done.where("gone_c is not null").alias("gone")
        on = [F.col(f"gone.{k}") == F.col(f"rank.{k}") for k in KEY]
        back = gone.join(ranks.alias("rank"), on).select(
            F.col("gone_c").alias("c"), F.col("gone_s").alias("s"), *[(F.col(f"rank.{w}") + F.col(f"before_{w}")).alias(w) for w in weights]
        )
        ranks, old = stored(ranks.unionByName(back), "ranks"), ranks
        discard(old, done)
    on = [F.col("run.hc") == F.col("rank.c"), F.col("run.hs") == F.col("rank.s")]
    sums = [(F.col(f"run.{w}") + F.col(f"rank.{w}")).alias(w) for w in weights]
    return runs.alias("run").join(ranks.alias("rank"), on).select("run.c", "run.s", *sums)


def _halved(level: DataFrame, weights: list[str], k: int) -> DataFrame:
    """A round of random mate; swallowed elements stand beside those that swallowed them."""

    def drew(keys):
        return F.xxhash64(*keys, F.lit(k)).bitwiseAND(F.lit(1))

    takes = F.coalesce((drew(KEY) == 0) & F.col("nc").isNotNull() & (drew(NEXT) == 1), F.lit(False))
    none = F.lit(None).cast("long")
    passed = level.where((drew(KEY) == 0) & ~takes).select(
        "*", none.alias("gone_c"), none.alias("gone_s"), *[none.alias(f"before_{w}") for w in weights]
    )
    on = [F.col("y.c") == F.col("x.nc"), F.col("y.s") == F.col("x.ns")]
    met = level.where(drew(KEY) == 1).alias("y").join(level.where(takes).alias("x"), on, "left")
    taken = F.col("x.c").isNotNull()
    return passed.unionByName(
        met.select(
            F.coalesce("x.c", "y.c").alias("c"),
            F.coalesce("x.s", "y.s").alias("s"),
            "y.nc",
            "y.ns",
            *[(F.col(f"y.{w}") + F.coalesce(f"x.{w}", F.lit(0))).alias(w) for w in weights],
            F.when(taken, F.col("y.c")).alias("gone_c"),
            F.when(taken, F.col("y.s")).alias("gone_s"),
            *[F.col(f"x.{w}").alias(f"before_{w}") for w in weights],
        )
    )
