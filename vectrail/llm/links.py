"""Connected components of link tables, by contraction on the cluster."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored

LOCAL_EDGES = 1 << 20


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) for every node of the edges (a, b)."""
    nodes, which = np.unique(np.concatenate((a, b)), return_inverse=True)
    left, right = which[: len(a)], which[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _forest(batches):
    """Replace the edges of a task by (node, smallest node reachable within them)."""
    left, right, held = [], [], 0

    def flush():
        nodes, roots = _roots(np.concatenate(left), np.concatenate(right))
        apart = nodes != roots
        return pa.RecordBatch.from_arrays([pa.array(nodes[apart]), pa.array(roots[apart])], names=["a", "b"])

    for batch in batches:
        left.append(batch.column("a").to_numpy()), right.append(batch.column("b").to_numpy())
        held += batch.num_rows
        if held >= LOCAL_EDGES:
            out = flush()
            yield out
            left, right, held = [], [], 0
    if held:
        yield flush()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (long columns a, b): root is the smallest node reachable.

    Each round every node points at its smallest neighbour, pointers are shortened once, and edges
    are contracted along them, which removes at least half of the nodes that still have edges. All
    state lies in written tables; a hub's edges are combined before they are shuffled.
    Self-links and repeated links do no harm; no edges give no rows.
    """
    ends = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null")
    nodes = None
    live = stored(ends.where("a <> b").mapInArrow(_forest, "a long, b long"), "edges")
    alone = ends.where("a = b").select("a")
    for _ in range(max_rounds):
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("b"))
        point = stored(near.select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "pointers")
        if nodes is None and point.isEmpty():
            break
        onward = point.select(F.col("node").alias("root"), F.col("root").alias("next"))
        point = stored(point.join(onward, "root").select("node", F.col("next").alias("root")), "pointers")
        if nodes is None:
            nodes = point
        else:
            step = point.select(F.col("node").alias("root"), F.col("root").alias("next"))
            nodes = stored(nodes.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        a, b = (point.select(F.col("node").alias(c), F.col("root").alias(f"to_{c}")) for c in "ab")
        moved = live.join(a, "a").join(b, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        live = stored(moved.where("a <> b").mapInArrow(_forest, "a long, b long").distinct(), "edges")
        if live.isEmpty():
            break
    else:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    own = alone.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    if nodes is None:
        return own
    return nodes.unionByName(own.join(nodes, "node", "left_anti"))
