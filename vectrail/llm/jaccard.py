"""Exact Jaccard join of documents' word shingles, with set-relation skipping.

1. One pass hashes every text to its shingle set: size, fingerprint, a few minima, and a fixed-size
   table of shingle frequencies. Equal sets are one node.
2. Sets with an equal minimum are compared with one of them, their hub: a linear number of
   comparisons that finds most of each group of similar sets. These answers serve all members.
3. Index lists: a shingle among the first of a set (rarest first) lists the set with its size and
   position. Blocks of a list that size or position rule out are skipped, and so is every pair whose
   sets the answers at hand already connect, or whose element parities show that they differ too
   much. A pair that shares a shingle just before is left to that shingle's list. What remains is
   compared exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .links import components
from .scratch import stored

WORDS = 5
MINIMA = 8
LIST_ROWS = 8192
BROADCAST_ROWS = 1_000_000
HUB_MEMBERS = 2000
PARITY_BITS = (256, 8192)  # least and most classes; otherwise about two to four for each element
BEFORE = 8  # shingles listed just before that go with an entry of a long list
_SALTS = np.random.default_rng(77).integers(1, 1 << 63, MINIMA, dtype=np.uint64)
_BASE_SCHEMA = "id {id}, n long, node long, minima array<long>, part int, counts binary"


def _signed(x) -> int:
    return int(np.uint64(x).astype(np.int64))


def _node(hashes: np.ndarray) -> int:
    both = np.append(blocks.mix(hashes), np.uint64(len(hashes))).sum(dtype=np.uint64)
    return _signed(blocks.mix(np.array([both], np.uint64))[0])


def _summaries(size: int, bits: int, schema: pa.Schema):
    parts = max(1, 1 << (bits - 14))

    def run(batches):
        counts = np.zeros(1 << bits, np.int32)
        for batch in batches:
            ids, rows, sizes, nodes, minima = batch.column("id"), [], [], [], []
            for row, hashes in blocks.shingle_sets(batch.column("text"), size):
                rows.append(row), sizes.append(len(hashes))
                if not len(hashes):
                    nodes.append(None), minima.append(None)
                    continue
                np.add.at(counts, (hashes >> np.uint64(64 - bits)).astype(np.int64), 1)
                nodes.append(_node(hashes))
                minima.append([_signed(blocks.mix(hashes ^ s).min()) for s in _SALTS])
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()),
                 pa.array(minima, pa.list_(pa.int64())), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                schema=schema,
            )
        held = [(k, part) for k, part in enumerate(np.split(counts, parts)) if part.any()]
        if held:
            n = len(held)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, schema.field("id").type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
                 pa.nulls(n, pa.list_(pa.int64())), pa.array([k for k, _ in held], pa.int32()),
                 pa.array([p.tobytes() for _, p in held], pa.binary())],
                schema=schema,
            )

    return run


def _summed(batches):
    """Sum the frequency tables of each part that a task holds."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
            new = np.frombuffer(counts, np.int32).astype(np.int64)
            held[part] = held[part] + new if part in held else new
    yield pa.RecordBatch.from_arrays(
        [pa.array(held, pa.int32()), pa.array([np.minimum(c, (1 << 31) - 1).astype(np.int32).tobytes() for c in held.values()], pa.binary())],
        names=["part", "counts"],
    )


def overlap_needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Smallest intersection of sets of n and m with 100 * intersection >= percent * union."""
    return -(-(percent * (n + m)) // (100 + percent))


def _parities(hashes: np.ndarray) -> bytes:
    """For each class of elements whether the set has an odd number of them.

    Two sets whose parities disagree in d classes differ in d elements at least.
    """
    classes = min(PARITY_BITS[1], max(PARITY_BITS[0], 1 << (2 * len(hashes)).bit_length()))
    odd = np.bincount((hashes & np.uint64(classes - 1)).astype(np.int64), minlength=classes) & 1
    return np.packbits(odd).tobytes()


def _before(tokens: np.ndarray, node: int) -> np.ndarray:
    """For each listed shingle of a set the ``BEFORE`` shingles listed before it, filled up with the node."""
    padded = np.concatenate((np.full(BEFORE, node, np.int64), tokens))
    return np.lib.stride_tricks.sliding_window_view(padded, BEFORE)[: len(tokens)]


def _listed_before(raw: list, nodes: np.ndarray) -> np.ndarray:
    """The shingles before each entry of a list; an entry without them has only its node, which no other set has."""
    out = np.repeat(nodes[:, None], BEFORE, axis=1)
    for row, tokens in enumerate(raw):
        if tokens is not None:
            out[row] = np.frombuffer(tokens, np.int64)
    return out


class _Apart:
    """Lower bounds of the differences between the sets of a list, from their parities."""

    def __init__(self, raw: list):
        self.width = np.array([len(b) // 8 if b else 0 for b in raw])
        self.place, self.full, self.half = np.zeros(len(raw), np.int64), {}, {}
        for w in set(self.width.tolist()) - {0}:
            rows = np.flatnonzero(self.width == w)
            self.place[rows] = np.arange(len(rows))
            self.full[w] = np.frombuffer(b"".join(raw[i] for i in rows), np.uint64).reshape(len(rows), w)
            self.half[w] = self.full[w][:, : w // 2] ^ self.full[w][:, w // 2 :]  # as for half as many classes

    def __call__(self, i: int, others: np.ndarray) -> np.ndarray:
        out, w = np.zeros(len(others), np.int64), int(self.width[i])
        if w:
            own = self.full[w][self.place[i]]
            for width, table in ((w, self.full), (2 * w, self.half)):
                at = np.flatnonzero(self.width[others] == width)
                if len(at):
                    out[at] = np.bitwise_count(table[width][self.place[others[at]]] ^ own).sum(axis=1, dtype=np.int64)
        return out


def _lists(size: int, percent: int, bits: int, frequency, schema: pa.Schema):
    def run(batches):
        counts = frequency.value
        mean = float(counts.mean())
        limit = max(LIST_ROWS, 8 * int(mean))
        line = mean + 2 * mean**0.5 + 2  # a shingle with more than this may be in many sets
        seen: set[int] = set()
        for batch in batches:
            out, parities, earlier = [[] for _ in range(6)], [], []
            comps = batch.column("comp").to_pylist()
            for row, hashes in blocks.shingle_sets(batch.column("text"), size):
                n = len(hashes)
                if not n:
                    continue
                node = _node(hashes)
                if node in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(node)
                often = counts[(hashes >> np.uint64(64 - bits)).astype(np.int64)]
                first = n + percent * n // -100 + 1  # n - ceil(percent * n / 100) + 1
                order = np.argsort(often, kind="stable")[:first]
                place = np.flatnonzero(often[order] > 1)  # a shingle counted once is in no other set
                order = order[place]
                parity = _parities(hashes) if (often[order] > line).any() else None
                shares = np.maximum(1, -(-often[order].astype(np.int64) // limit))
                token, comp = hashes[order].astype(np.int64), node if comps[row] is None else comps[row]
                before = _before(token, node)
                for share in np.unique(shares):
                    at = shares == share
                    own = (node & 0x7FFFFFFF) % int(share)
                    for other in range(int(share)):
                        pair = min(own, other) * int(share) + max(own, other)
                        k = int(at.sum())
                        long = often[order[at]] > line
                        parities += [parity if x else None for x in long]
                        earlier += [b.tobytes() if x else None for x, b in zip(long, before[at])]
                        for values, column in zip(out, (token[at], np.full(k, pair), np.full(k, n), place[at], np.full(k, node), np.full(k, comp))):
                            values.append(column)
            if out[0]:
                arrays = [pa.array(np.concatenate(c).astype(f.type.to_pandas_dtype())) for c, f in zip(out, schema)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(parities, pa.binary()), pa.array(earlier, pa.binary())], schema=schema)

    return run


def _candidates(percent: int):
    """Pairs of a list that size, position and known answers leave over.

    The first shingle that two sets both list comes nowhere else before, and its bounds are the
    loosest, so a pair is never lost by leaving it to a shingle that both list earlier.
    """

    def run(batches):
        for table in blocks.sorted_groups(batches, ["token", "pair"]):
            token, pair, n, place, node, comp = (table.column(c).to_numpy() for c in ("token", "pair", "n", "place", "node", "comp"))
            cut = np.flatnonzero((token[1:] != token[:-1]) | (pair[1:] != pair[:-1])) + 1
            bounds = np.concatenate(([0], cut, [len(token)]))
            sizes = np.diff(bounds)
            found_a, found_b, held = [], [], 0
            for g in np.flatnonzero(sizes > 1):
                lo, hi = bounds[g], bounds[g + 1]
                if (comp[lo:hi] == comp[lo]).all():
                    continue
                bound = _Apart(table.column("bits").slice(lo, hi - lo).to_pylist())
                before = _listed_before(table.column("before").slice(lo, hi - lo).to_pylist(), node[lo:hi])
                for i in range(lo, hi - 1):  # sorted by size: skip to the block of sizes in reach
                    end = lo + int(np.searchsorted(n[lo:hi], 100 * n[i] // percent, "right"))
                    if end <= i + 1:
                        continue
                    others = np.arange(i + 1, end)
                    others = others[comp[others] != comp[i]]
                    if not len(others):
                        continue
                    most = np.minimum(n[i] - place[i], n[others] - place[others])
                    needed = overlap_needed(n[i], n[others], percent)
                    apart = bound(i - lo, others - lo)
                    others = others[(most >= needed) & (apart <= n[i] + n[others] - 2 * needed)]
                    known = (before[others - lo][:, :, None] == before[i - lo]).any(axis=(1, 2))
                    others = others[~known]
                    if len(others):
                        found_a.append(np.minimum(node[i], node[others])), found_b.append(np.maximum(node[i], node[others]))
                        held += len(others)
                        if held > 1 << 18:
                            yield _pairs(found_a, found_b)
                            found_a, found_b, held = [], [], 0
            if held:
                yield _pairs(found_a, found_b)

    return run


def _pairs(a: list, b: list) -> pa.RecordBatch:
    both = np.unique(np.stack((np.concatenate(a), np.concatenate(b)), axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def _sets(size: int):
    def run(batches):
        for batch in batches:
            nodes, sets = [], []
            held = 0
            for _, hashes in blocks.shingle_sets(batch.column("text"), size):
                nodes.append(_node(hashes)), sets.append(hashes.tobytes())
                held += len(sets[-1])
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "hashes"])
                    nodes, sets, held = [], [], 0
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "hashes"])

    return run


def _verified(percent: int):
    """Links of hubs with members; rows come sorted by (hub, share), the hub's own set first."""

    def run(batches):
        hub = share = own = None
        for batch in batches:  # a set may come twice if an id does
            a, b = [], []
            hubs, shares, members = (batch.column(c).to_numpy() for c in ("a", "share", "b"))
            for k, raw in enumerate(batch.column("hashes")):
                hashes = np.frombuffer(raw.as_buffer(), np.uint64)
                if (hubs[k], shares[k]) != (hub, share):
                    hub, share, own = hubs[k], shares[k], None
                if members[k] == hub:
                    own = hashes
                    continue
                if own is None:
                    continue
                small, large = (own, hashes) if len(own) < len(hashes) else (hashes, own)
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                if (100 + percent) * both >= percent * (len(own) + len(hashes)):
                    a.append(hub), b.append(members[k])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _with_few(df: DataFrame, few: DataFrame, on: str, how: str) -> DataFrame:
    """Join; ``few`` is broadcast only if it has at most ``BROADCAST_ROWS`` rows of a few numbers each."""
    return df.join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, on, how)


def _links(texts: DataFrame, reps: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar, compared whole."""
    pairs = stored(pairs.where("a <> b"), "pairs")
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    ids = stored(reps.join(needed, "node").select(F.col("rep").alias("id")), "needed")
    sets = _with_few(texts, ids, "id", "left_semi").select("text").mapInArrow(_sets(size), "b long, hashes binary")
    hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_MEMBERS).cast("int").alias("shares"))
    share = F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share")
    members = pairs.join(hubs, "a").select("a", share, "b")
    selves = hubs.select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("a").alias("b"))
    rows = _with_few(sets, stored(members.unionByName(selves), "members"), "b", "inner")
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("first", F.col("a") != F.col("b")).repartition(tasks, "a", "share")
    rows = rows.sortWithinPartitions("a", "share", "first").select("a", "share", "b", "hashes")
    return stored(rows.mapInArrow(_verified(percent), "a long, b long"), "links")


def _stars(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of a hub and a set that has two of its minima at least.

    The hub of a minimum is the set whose minima are the most common: the middle of a group.
    """
    keys = nodes.select("node", F.posexplode("minima").alias("k", "key"))
    common = keys.groupBy("k", "key").agg(F.count("*").alias("many")).where("many > 1")
    live = stored(keys.join(common, ["k", "key"]), "minima")
    weight = live.groupBy("node").agg(F.sum("many").alias("weight"))
    live = stored(live.join(weight, "node").select("k", "key", "node", "weight"), "weighted-minima")
    hubs = live.groupBy("k", "key").agg(F.max(F.struct("weight", "node"))["node"].alias("a"))
    stars = live.join(hubs, ["k", "key"]).where("a <> node")
    return stars.groupBy("a", F.col("node").alias("b")).agg(F.count("*").alias("alike")).where("alike > 1").select("a", "b")


def similar_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 80,
    size: int = WORDS,
    bits: int = 20,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_shingles, component_id``.

    Sets are the distinct shingles of ``size`` words (A-Z lowered, split at ASCII white space); a text
    with fewer words is one shingle, and one without words, empty or null is linked with nothing. Two
    rows link when 100 * intersection >= percent * union; ``component_id`` is the smallest id reachable
    by links, the row's own id included. Rows that repeat an id are judged each by its own text; rows
    with a null id get a null component unless a link gives one. Other columns are ignored. No rows
    give no rows. Shingles count as equal when their 64-bit hashes are.

    No pair is skipped but by a bound or because links found already connect it, so components are
    exact. Hot shingles come last in the order by frequency; lists longer than ``LIST_ROWS`` are
    split into pairs of shares. The frequency table has ``2**bits`` counters whatever the corpus.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = texts.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("id", to_arrow_type(id_type)), ("n", pa.int64()), ("node", pa.int64()), ("minima", pa.list_(pa.int64())), ("part", pa.int32()), ("counts", pa.binary())])
    every = stored(texts.mapInArrow(_summaries(size, bits, schema), _BASE_SCHEMA.format(id=id_type.simpleString())), "summaries")
    base = every.where("part is null").select("id", "n", "node", "minima")
    frequency = np.zeros(1 << bits, np.int32)
    tables = every.where("part is not null").select("part", "counts")
    for row in tables.repartition(8, "part").mapInArrow(_summed, "part int, counts binary").collect():
        part = np.frombuffer(row.counts, np.int32)
        frequency[row.part * len(part) : (row.part + 1) * len(part)] = part
    held = spark.sparkContext.broadcast(frequency)

    nodes = stored(base.where("n > 0").groupBy("node").agg(F.min("id").alias("rep"), F.first("minima").alias("minima")), "nodes")
    reps = nodes.select("node", "rep")
    links = _links(texts, reps, _stars(nodes), size, percent)
    known = stored(components(links), "known")

    rows = base.where("n > 0").select("id", "node").join(reps, "node", "left").join(known, "node", "left")
    marks = rows.where("root is not null or not (id <=> rep)")
    marks = stored(marks.groupBy("id").agg(F.max("root").alias("comp"), F.max(F.col("id").eqNullSafe(F.col("rep")).cast("int")).alias("keep"), F.count("*").alias("rows")), "marks")
    listed = _with_few(texts, marks, "id", "left").where("keep is null or keep = 1 or rows > 1")
    listed = listed.select("text", F.when(F.col("rows") > 1, None).otherwise(F.col("comp")).alias("comp"))
    list_schema = pa.schema([("token", pa.int64()), ("pair", pa.int32()), ("n", pa.int32()), ("place", pa.int32()), ("node", pa.int64()), ("comp", pa.int64()), ("bits", pa.binary()), ("before", pa.binary())])
    lists = listed.mapInArrow(_lists(size, percent, bits, held, list_schema), "token long, pair int, n int, place int, node long, comp long, bits binary, before binary")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = lists.repartition(tasks, "token", "pair").sortWithinPartitions("token", "pair", "n")
    pairs = lists.mapInArrow(_candidates(percent), "a long, b long").distinct()
    more = _links(texts, reps, pairs, size, percent)

    found = stored(components(links.unionByName(more)), "components")
    lowest = found.join(reps, "node").groupBy("root").agg(F.min("rep").alias("low"))
    labels = reps.join(found, "node", "left").join(lowest, "root", "left")
    labels = stored(labels.select("node", F.coalesce("low", "rep").alias("component_id")), "labels")
    return base.join(labels, "node", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"),
    )
