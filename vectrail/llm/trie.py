"""Prefix trie of conversations by the Euler-tour technique.

A node is a distinct sequence of first turns. Sequences are told apart by two polynomials of 61 bits
over turn digests; polynomials of parts add up, so a conversation may span any number of tasks. Every
node has an arc that enters it and one that leaves it. The tour over all arcs is a linked list; ranked
with weights, it gives leaves and savings of a subtree as a difference of sums at the node's two arcs.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import rank_list
from .scratch import discard, stored

SHARED = 5  # most turns that a rebuilt conversation takes from another
PRIME = (1 << 61) - 1
BASES = (1_174_936_482_309_731_053, 1_903_774_206_415_587_629)
IDS_PER_CHUNK = 8192
NO_ENDS = hashlib.sha256(b"").hexdigest()
_LANES = ["p1", "p2", "q1", "q2"]


def _positions(batches):
    """Turns of a sorted range with their place in the conversation and the polynomials up to (p) and before (q) them."""
    part, now, place, sums, powers = TaskContext.get().partitionId(), None, 0, [0, 0], [1, 1]
    for batch in batches:
        out = {n: [] for n in ["pos", *_LANES]}
        for conv, *token in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "t1", "t2"))):
            if conv != now:
                now, place, sums, powers = conv, 0, [0, 0], [1, 1]
            place += 1
            before = sums
            powers = [x * b % PRIME for x, b in zip(powers, BASES)]
            sums = [(x + t * y) % PRIME for x, t, y in zip(sums, token, powers)]
            for n, v in zip(out, (place, *sums, *before)):
                out[n].append(v)
        arrays = [batch.column("conv_id"), batch.column("n_chars"), pa.array([part] * batch.num_rows, pa.int64())]
        arrays += [pa.array(v, pa.int64()) for v in out.values()]
        yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "n_chars", "part", *out])


def _carried(ranges: list) -> dict[int, tuple]:
    """For every range whose first conversation began earlier: its id, turns so far and polynomials so far."""
    out, open_ = {}, None
    for r in sorted(ranges, key=lambda r: r.part):
        began = open_ if open_ and open_[0] == r.first else None
        if began:
            out[r.part] = began
        conv, n, sums = r.last.conv_id, r.last.pos, [r.last.p1, r.last.p2]
        if began and conv == r.first:
            sums = [(a + pow(b, began[1], PRIME) * x) % PRIME for a, b, x in zip(began[2:], BASES, sums)]
            n += began[1]
        open_ = (conv, n, *sums)
    return out


def _continued(carried: dict[int, tuple]):
    def run(batches):
        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            for i, part in enumerate(columns["part"]):
                conv, n, *sums = carried.get(part, (None, 0))
                if conv is not None and conv == columns["conv_id"][i]:
                    columns["pos"][i] += n
                    for lane in _LANES:
                        k = int(lane[1]) - 1
                        columns[lane][i] = (sums[k] + pow(BASES[k], n, PRIME) * columns[lane][i]) % PRIME
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns.values()], names=list(columns))

    return run


def _shifted(batches):
    """Own turns of rebuilt conversations: depth, and the polynomials of the rebuilt sequence up to and before them."""
    back = [[pow(b, -k, PRIME) for k in range(SHARED + 1)] for b in BASES]
    names = ["conv_id", "depth", "k1", "k2", "u1", "u2", "n_chars", "ended"]
    for batch in batches:
        col = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        gap = [h - a for h, a in zip(col["h"], col["a"])]
        depth = [p - g for p, g in zip(col["pos"], gap)]
        keys = [
            [(a + (x - own) * back[k][g]) % PRIME for a, x, own, g in zip(col[f"a{k + 1}"], col[f"{lane}{k + 1}"], col[f"h{k + 1}"], gap)]
            for lane in "pq"
            for k in (0, 1)
        ]
        ended = [d == n for d, n in zip(depth, col["length"])]
        arrays = [batch.column("conv_id"), pa.array(depth, pa.int64()), *[pa.array(k, pa.int64()) for k in keys]]
        yield pa.RecordBatch.from_arrays([*arrays, batch.column("n_chars"), pa.array(ended)], names=names)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos`` (from 1), ``n_chars`` and prefix polynomials of all turns, whatever a conversation's length."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.char_length(text).cast("long").alias("n_chars")
    )
    lanes = [F.conv(F.substring("digest", at, 15), 16, 10).cast("long").alias(n) for n, at in (("t1", 1), ("t2", 16))]
    order = ["conv_id", F.asc_nulls_first("turn"), "t1", "t2"]
    turns = turns.select("conv_id", "turn", "n_chars", *lanes).repartitionByRange(*order).sortWithinPartitions(*order)
    names = ["conv_id", "n_chars", "part", "pos", *_LANES]
    ddl = ", ".join(f"{n} long" for n in names)
    local = stored(turns.select("conv_id", "t1", "t2", "n_chars").mapInArrow(_positions, ddl), "turns")
    last = F.max_by(F.struct("conv_id", "pos", "p1", "p2"), F.struct("conv_id", "pos"))
    carried = _carried(local.groupBy("part").agg(F.min("conv_id").alias("first"), last.alias("last")).collect())
    if not carried:
        return local
    turns = stored(local.mapInArrow(_continued(carried), ddl), "continued")
    discard(local)
    return turns


def rebuilt_members(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations with their rebuilt ``length``, one row for each conversation and depth).

    The first h = crc32(id) mod 6 turns come from conversation id - id mod 100, the rest are its own from h + 1 on.
    """
    head = F.collect_list(F.when(F.col("pos") <= SHARED, F.struct("pos", *_LANES, "n_chars")))
    convs = stored(turns.groupBy("conv_id").agg(F.max("pos").alias("n"), F.sort_array(head).alias("head")), "heads")
    lender = convs.select(F.col("conv_id").alias("lender"), F.col("head").alias("lent"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int")
    known = convs.withColumn("lender", F.col("conv_id") - F.col("conv_id") % 100).join(lender, "lender", "left").withColumn("h", h)
    known = known.withColumn("a", F.least("h", F.when(F.col("lent").isNull(), 0).otherwise(F.size("lent"))))
    at = lambda array, n, lane: F.coalesce(F.get(array, F.col(n) - 1)[lane], F.lit(0).cast("long"))
    known = known.select(
        "conv_id",
        "n",
        "h",
        "a",
        (F.col("a") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"),
        F.when(F.col("a") > 0, F.slice("lent", 1, F.col("a"))).alias("lent"),
        *[at("lent", "a", f"p{k}").alias(f"a{k}") for k in (1, 2)],
        *[at("head", "h", f"p{k}").alias(f"h{k}") for k in (1, 2)],
    )
    known = stored(known, "rebuilt")
    discard(convs)
    lent = known.select("conv_id", "length", F.explode("lent").alias("t")).select(
        "conv_id",
        F.col("t.pos").alias("depth"),
        F.col("t.p1").alias("k1"),
        F.col("t.p2").alias("k2"),
        F.col("t.q1").alias("u1"),
        F.col("t.q2").alias("u2"),
        "t.n_chars",
        (F.col("t.pos") == F.col("length")).alias("ended"),
    )
    own = turns.join(known.where("n > h").select("conv_id", "h", "a", "length", "a1", "a2", "h1", "h2"), "conv_id").where("pos > h")
    ddl = "conv_id long, depth long, k1 long, k2 long, u1 long, u2 long, n_chars long, ended boolean"
    return known, lent.unionByName(own.mapInArrow(_shifted, ddl))


def _listed(batches):
    """Ascending ids of a node as comma-joined chunks."""
    for batch in batches:
        rows = zip(*(batch.column(n).to_pylist() for n in ("depth", "k1", "k2", "conv_id")))
        out = []
        for key, group in groupby(rows, key=lambda r: r[:3]):
            ids = [r[3] for r in group]
            for i in range(0, len(ids), IDS_PER_CHUNK):
                out.append((*key, ids[i], ",".join(map(str, ids[i : i + IDS_PER_CHUNK]))))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["depth", "k1", "k2", "first_id", "ids"])


def _hashed(batches):
    """The digest of each node's chunks, one after the other; only a hash state is held."""
    key, state, done = None, None, []
    for batch in batches:
        for *now, ids in zip(*(batch.column(n).to_pylist() for n in ("depth", "k1", "k2", "ids"))):
            if now == key:
                state.update(b",")
            else:
                if key:
                    done.append((*key, state.hexdigest()))
                key, state = now, hashlib.sha256()
            state.update(ids.encode())
    if key:
        done.append((*key, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["depth", "k1", "k2", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """The digest of the ids that end at each node. Ids are sorted over the cluster; a node's digest then reads them as chunks in order."""
    key = ["depth", "k1", "k2"]
    chunks = ends.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")
    chunks = chunks.mapInArrow(_listed, "depth long, k1 long, k2 long, first_id long, ids string")
    # The hash runs over a node's ids in order, so a node's chunks meet in one task, which streams them.
    chunks = chunks.repartition(*key).sortWithinPartitions(*key, "first_id")
    return chunks.mapInArrow(_hashed, "depth long, k1 long, k2 long, ends_sha256 string")


_ARC = ["c", "s", "nc", "ns", "place", "leaves", "saved"]


def _sibling_arcs(batches):
    """Arcs between neighbours of a range of nodes sorted by parent; the range's first and last node are handed on as edges."""
    part, held, first = TaskContext.get().partitionId(), None, None
    columns = ["depth", "parent", "conv_id", "leaves", "saved"]

    def rows(arcs, edge):
        arcs = np.asarray(arcs, np.int64).reshape(-1, len(_ARC))
        arrays = [pa.array(arcs[:, k]) for k in range(len(_ARC))]
        return pa.RecordBatch.from_arrays(
            [*arrays, pa.array([part] * len(arcs), pa.int64()), pa.array([edge] * len(arcs), pa.int32())], names=[*_ARC, "part", "edge"]
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        block = np.column_stack([batch.column(n).to_numpy() for n in columns]).astype(np.int64)
        if held is None:
            first = block[0]
        else:
            block = np.vstack((held, block))
        held = block[-1:]
        a, b = block[:-1], block[1:]
        same = (a[:, 0] == b[:, 0]) & (a[:, 1] == b[:, 1])
        one = np.ones(len(a), np.int64)
        leave = [a[:, 2], 2 * a[:, 0] + 1]
        to = [np.where(same, b[:, 2], a[:, 1]), np.where(same, 2 * b[:, 0], 2 * a[:, 0] - 1)]
        yield rows(np.column_stack((*leave, *to, one, a[:, 3], a[:, 4])), 0)
        n = b[~same]
        nil = np.zeros(len(n), np.int64)
        yield rows(np.column_stack((n[:, 1], 2 * n[:, 0] - 2, n[:, 2], 2 * n[:, 0], nil + 1, nil, nil)), 0)
    if held is not None:
        for edge, node in ((1, first), (2, held[0])):
            yield rows([[*node, 0, 0]], edge)


def _edge_arcs(edges: list) -> list[tuple]:
    """Arcs across the limits of ranges: from every range's last node on, and into a parent's first child."""
    nodes = [(r.edge, r.c, r.s, r.nc, r.ns, r.place) for r in sorted(edges, key=lambda r: (r.part, r.edge))]
    out = []
    for i, (edge, depth, parent, conv, leaves, saved) in enumerate(nodes):
        if edge == 2:
            following = nodes[i + 1] if i + 1 < len(nodes) else None
            sibling = following and following[1:3] == (depth, parent)
            to = (following[3], 2 * depth) if sibling else (parent, 2 * depth - 1)
            out.append((conv, 2 * depth + 1, *to, 1, leaves, saved))
        elif not i or nodes[i - 1][1:3] != (depth, parent):
            out.append((parent, 2 * depth - 2, conv, 2 * depth, 1, 0, 0))
    return out


def euler_tour(tree: DataFrame) -> DataFrame:
    """Arcs of the tour as a linked list, children in the order of their ids.

    ``c, s``: the node's ``conv_id``, and twice its depth, plus 1 if the arc leaves it. An arc that
    leaves a node carries its own leaf (``leaves``) and saving (``saved``).
    """
    spark = tree.sparkSession
    nodes = tree.withColumn("leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"))
    order = ["depth", "parent_conv_id", "conv_id"]
    below = nodes.where("depth > 0").repartitionByRange(*order).sortWithinPartitions(*order)
    below = below.select("depth", F.col("parent_conv_id").alias("parent"), "conv_id", "leaves", "saved")
    ddl = ", ".join(f"{n} long" for n in [*_ARC, "part"]) + ", edge int"
    arcs = stored(below.mapInArrow(_sibling_arcs, ddl), "arcs")
    edges = spark.createDataFrame(_edge_arcs(arcs.where("edge > 0").collect()), ", ".join(f"{n} long" for n in _ARC))
    twice = F.col("depth") * 2
    one, nil, none = F.lit(1).cast("long"), F.lit(0).cast("long"), F.lit(None).cast("long")
    turning = nodes.where("leaves = 1").select(F.col("conv_id").alias("c"), twice.alias("s"), F.col("conv_id").alias("nc"), (twice + 1).alias("ns"), one.alias("place"), nil.alias("leaves"), nil.alias("saved"))
    end = nodes.where("depth = 0").select(F.col("conv_id").alias("c"), (twice + 1).alias("s"), none.alias("nc"), none.alias("ns"), one.alias("place"), "leaves", "saved")
    return arcs.where("edge = 0").select(*_ARC).unionByName(edges).unionByName(turning).unionByName(end)


def conversation_trie(conversations: DataFrame, per_task: int | None = None, last: int | None = None) -> DataFrame:
    """One row per distinct sequence of first turns (role, text) of the rebuilt conversations, the empty one included.

    ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256`` as the query's contract has them, and ``enter_at, leave_at``: the node's places in the
    tour. Null roles and texts are empty; a null turn comes first; turns of the same number stand in the
    order of a digest of role and text, and repeated rows are turns of their own. Rows without a
    ``conv_id`` belong to no conversation and are left out. Empty texts save nothing. Other columns are
    ignored, whatever their names. No conversations give no rows.

    No conversation, sibling list or subtree has to fit a task. Only the ids that end at one node meet in
    one task, as their digest is one stream; it holds a chunk of ids at a time. ``per_task`` and ``last``
    are those of ``rank_list``.
    """
    turns = numbered_turns(conversations)
    known, members = rebuilt_members(turns)
    members = stored(members, "members")
    discard(turns)
    key = ["depth", "k1", "k2"]
    nodes = stored(
        members.groupBy(*key).agg(*[F.min(c).alias(c) for c in ("conv_id", "u1", "u2", "n_chars")], F.count("*").alias("n_convs")), "nodes"
    )
    zero = F.lit(0).cast("long")
    whole = known.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).first()  # the root
    columns = [*key, "conv_id", "parent_conv_id", "n_convs", "n_chars"]
    root = members.sparkSession.createDataFrame([(0, 0, 0, whole.conv_id, None, whole.n_convs, 0)] * (whole.n_convs > 0), ", ".join(f"{c} long" for c in columns))
    upper = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("conv_id").alias("parent_conv_id"))
    tree = nodes.where("depth > 1").join(upper, ["depth", "u1", "u2"]).select(*columns)
    top = nodes.where("depth = 1").withColumn("parent_conv_id", F.lit(whole.conv_id).cast("long"))
    tree = tree.unionByName(top.select(*columns)).unionByName(root)
    tree = stored(tree, "tree")
    discard(nodes)
    counts = tree.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    tree = tree.join(counts, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", zero))
    tree = stored(tree.withColumn("saved", (F.col("n_convs") - 1) * F.col("n_chars")), "counted")
    limits = {k: v for k, v in (("per_task", per_task), ("last", last)) if v}
    ranked = rank_list(euler_tour(tree), ["place", "leaves", "saved"], **limits)
    leaves_it = F.col("s") % 2 == 1
    inner = [(F.max(F.when(leaves_it, F.col(w))) - F.max(F.when(~leaves_it, F.col(w)))).alias(n) for w, n in (("leaves", "n_leaves"), ("saved", "saved_tokens"))]
    at = [F.max(F.when(x, F.col("place"))).alias(n) for x, n in ((~leaves_it, "enter_at"), (leaves_it, "leave_at"))]
    sums = ranked.groupBy(F.col("c").alias("conv_id"), F.shiftright("s", 1).alias("depth")).agg(*inner, *at)
    turnless = known.where("length = 0").select("conv_id", *[zero.alias(k) for k in key])
    ends = end_digests(members.where("ended").select("conv_id", *key).unionByName(turnless))
    done = tree.join(sums, ["conv_id", "depth"]).join(ends, key, "left")
    return done.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"), "enter_at", "leave_at"
    )
