"""Removal of repeated substrings by column-wise multi-document construction.

Every window of ``LENGTH`` bytes is governed by an anchor that its bytes choose, so equal windows
meet under equal anchors. The neighbouring windows of an anchor make a short document; the documents
of an anchor that is found more than once form a collection, aligned at the anchor. Its sorted order
is built column by column from the right: each round puts one symbol before every document's suffix,
regroups the order by it, stably, and updates the common prefixes of neighbours. When a column is
done, a window that starts there is repeated if it shares ``LENGTH`` bytes with a neighbour.
Between the steps everything lies in sequential files in the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import anchors, blocks
from .scratch import discard, stored, stored_bytes

LENGTH = 200
LARGE_GROUP = 8192
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 24 << 20
FILTER_BITS = 27
TASK_DOCUMENTS = 50_000
_FOUND = "doc long, key long, span long, start long, windows int, place int"


def _anchors(length: int, gram: int):
    types = {"key": pa.int64(), "span": pa.int64(), "start": pa.int64(), "windows": pa.int32(), "place": pa.int32()}

    def run(batches):
        for batch in batches:
            docs = batch.column("doc")
            for found in anchors.governed(batch.column("text"), length, gram):
                arrays = [docs.take(pa.array(found["row"]))] + [pa.array(found[c].astype(t.to_pandas_dtype())) for c, t in types.items()]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc", *types])

    return run


def _cut_out(length: int):
    """The bytes of each wanted run of windows."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(7)]
            held = 0
            texts = batch.column("text")
            for doc, text, wanted in zip(batch.column("doc").to_pylist(), texts, batch.column("wanted").to_pylist()):
                raw = text.as_py().encode()
                for w in wanted:
                    piece = raw[w["start"] : w["start"] + w["windows"] - 1 + length]
                    for column, value in zip(out, (doc, w["key"], w["start"], w["windows"], w["place"], w["n"], piece)):
                        column.append(value)
                    held += len(piece)
                if held > 4 << 20:
                    yield _pieces(out)
                    out, held = [[] for _ in range(7)], 0
            if held:
                yield _pieces(out)

    return run


def _pieces(columns: list) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc", "key", "start", "windows", "place", "n", "bytes"])


def repeated_windows(groups: np.ndarray, places: np.ndarray, windows: np.ndarray, pieces: list[bytes], length: int) -> np.ndarray:
    """For aligned documents, sorted by group: which of each one's first ``windows`` bytes start a ``length``-byte
    string that another document of its group holds at the same distance from the anchor."""
    n = len(pieces)
    sizes = np.array([len(p) for p in pieces], np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    flat = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64) + 1
    first, last = int(-places.max()), int((sizes - places).max())
    group = np.cumsum(np.concatenate(([0], groups[1:] != groups[:-1])))
    marks = np.zeros((n, int(windows.max())), bool)
    order = np.arange(n)
    common = np.zeros(n, np.int64)  # shared prefix with the one before in the order; 0 at a group's first
    for column in range(last - 1, first - 1, -1):
        at = column + places
        inside = (at >= 0) & (at < sizes)
        symbol = np.where(inside, flat[np.minimum(offsets[:-1] + np.maximum(at, 0), len(flat) - 1)], 0)
        key = group[order] * 257 + symbol[order]
        moved = np.argsort(key, kind="stable")
        same = np.zeros(n, bool)
        same[1:] = (key[moved][1:] == key[moved][:-1]) & (symbol[order][moved][1:] > 0)
        shared = np.zeros(n, np.int64)
        later = np.flatnonzero(same)
        if len(later):
            bounds = np.empty(2 * len(later), np.int64)
            bounds[::2], bounds[1::2] = moved[later - 1] + 1, moved[later] + 1
            least = np.minimum.reduceat(np.append(common, 0), bounds)[::2]
            shared[later] = np.minimum(least + 1, length)
        order, common = order[moved], shared
        full = common >= length
        near = full.copy()
        near[:-1] |= full[1:]
        hit = order[near]
        starts = column + places[hit]
        fits = (starts >= 0) & (starts < windows[hit])
        marks[hit[fits], starts[fits]] = True
    return marks


def _columns(length: int):
    def run(batches):
        def solved(tables):
            table = pa.concat_tables(tables)
            column = {c: table.column(c).to_numpy() for c in ("doc", "key", "start", "windows", "place", "n")}
            marks = repeated_windows(column["key"], column["place"].astype(np.int64), column["windows"], table.column("bytes").to_pylist(), length)
            marks[column["n"] > 1] = False  # those are repeated whole
            padded = np.zeros((len(marks), marks.shape[1] + 2), np.int8)
            padded[:, 1:-1] = marks
            change = np.diff(padded, axis=1)
            row, start = np.nonzero(change == 1)
            _, end = np.nonzero(change == -1)
            begin = column["start"][row] + start
            return pa.RecordBatch.from_arrays([pa.array(column["doc"][row]), pa.array(begin), pa.array(column["start"][row] + end - 1 + length)], names=["doc", "begin", "stop"])

        held, rows = [], 0
        for table in blocks.sorted_groups(batches, ["key"]):
            held.append(table)
            rows += table.num_rows
            if rows >= TASK_DOCUMENTS:
                yield solved(held)
                held, rows = [], 0
        if rows:
            yield solved(held)

    return run


def _single_windows(length: int):
    """Every window of a document by its hash, for collections too large for one task."""

    def run(batches):
        for batch in batches:
            docs, keys, starts, hashes, spans = [], [], [], [], []
            for k, piece in enumerate(batch.column("bytes")):
                data = np.frombuffer(piece.as_buffer(), np.uint8)
                n = batch.column("windows")[k].as_py()
                prefix = blocks.prefix_hash(data)
                at = np.arange(n)
                whole = blocks.range_hash(prefix, at, at + length).view(np.int64)
                docs.append(np.full(n, batch.column("doc")[k].as_py())), keys.append(np.full(n, batch.column("key")[k].as_py()))
                starts.append(batch.column("start")[k].as_py() + at), hashes.append(whole)
                spans.append(np.full(n, batch.column("n")[k].as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (docs, keys, starts, hashes, spans)], names=["doc", "key", "begin", "hash", "n"])

    return run


def _merged(batches):
    """The ranges of each text in order, those that meet or overlap as one."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ranges = batch.column("ranges")
        begin, stop = (part.to_numpy() for part in ranges.flatten().flatten())
        row = np.repeat(np.arange(batch.num_rows), ranges.value_lengths().to_numpy())
        apart = row * (int(stop.max()) + 1)  # texts one behind the other
        order = np.argsort(begin + apart, kind="stable")
        row, apart = row[order], apart[order]
        reach = np.maximum.accumulate(stop[order] + apart)
        new = np.ones(len(reach), bool)
        new[1:] = (begin[order] + apart)[1:] > reach[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(reach)) - 1
        runs = pa.StructArray.from_arrays([pa.array(begin[order][first]), pa.array((reach - apart)[last])], names=["begin", "stop"])
        bounds = np.searchsorted(row[first], np.arange(batch.num_rows + 1))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs)], names=["doc", "ranges"])


def _removed(schema: pa.Schema):
    def run(batches):
        for batch in batches:
            kept, spans, sizes = [], [], []
            for text, ranges in zip(batch.column("text"), batch.column("ranges").to_pylist()):
                raw, at, left = text.as_py().encode(), 0, []
                for r in ranges or ():
                    left.append(raw[at : r["begin"]])
                    at = r["stop"]
                left.append(raw[at:])
                kept.append(b"".join(left)), sizes.append(len(raw))
                spans.append(ranges or [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, schema.field("spans").type)], schema=schema
            )

    return run


def may_have(texts: DataFrame, lists: DataFrame) -> DataFrame:
    """``texts`` with ``known``: true for every text that has a list, false for most others.

    A bitmap over the leading bits of ``doc`` is broadcast: a byte a list or more, at most ``1 << FILTER_BITS`` bits.
    """
    bits = min(FILTER_BITS, max(16, (8 * lists.count()).bit_length()))
    slot = F.shiftrightunsigned("doc", 64 - bits)
    maps = lists.groupBy(F.bitmap_bucket_number(slot).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("map"))
    bit = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("map", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = texts.join(F.broadcast(maps), F.bitmap_bucket_number(slot) == F.col("block"), "left")
    return found.select(*texts.columns, F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False)).alias("known"))


def with_lists(texts: DataFrame, lists: DataFrame, every: bool = False) -> DataFrame:
    """``texts`` beside their lists, by ``doc``; if ``every`` those without one too, with null.

    Lists that are stored in few bytes are broadcast. Else only texts that may have one are shuffled.
    """
    if stored_bytes(lists) <= BROADCAST_BYTES:
        return texts.join(F.broadcast(lists), "doc", "left" if every else "inner")
    marked = may_have(texts, lists)
    joined = marked.where("known").drop("known").join(lists, "doc", "left" if every else "inner")
    if not every:
        return joined
    return joined.unionByName(marked.where("not known").drop("known"), allowMissingColumns=True)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = anchors.GRAM) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_bytes, kept`` (binary) and ``spans`` (begin, stop) removed.

    A text is its UTF-8 bytes; null counts as empty. Removed is each byte that lies in a string of
    ``length`` bytes that also starts anywhere else, in this text or another; strings are judged on
    the input. Rows that repeat, ids and all, count as texts of their own. Null ids are passed on,
    texts under ``length`` bytes stay whole, other columns are ignored, no rows give no rows.

    About one row per fifty bytes is shuffled to find anchors met twice; only those go on. Equal
    documents of an anchor enter its collection once. A collection of more than ``LARGE_GROUP``
    different documents is not brought together: its windows are counted one by one by their hash.
    Texts move only where lists too long to be broadcast name them, and the rows of all anchors are
    deleted once the repeated ones are stored.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = source.withColumn("doc", F.xxhash64("id", "text"))
    found = stored(named.select("doc", "text").mapInArrow(_anchors(length, gram), _FOUND), "anchors")
    keys = found.groupBy("key").agg(F.count("*").alias("n"), F.min("span").alias("low"), F.max("span").alias("high")).where("n > 1")
    keys = stored(keys.select("key", (F.col("low") != F.col("high")).alias("mixed")), "keys")
    again = stored(found.join(keys, "key"), "repeats", buckets="mixed")
    discard(found, keys)
    end = F.col("start") + F.col("windows") - 1 + length
    mixed = again.where("mixed")
    spans = mixed.groupBy("key", "span").agg(F.count("*").alias("n"), F.min(F.struct("doc", "start", "windows", "place")).alias("at"))
    spans = stored(spans.select("key", "span", "n", "at.*"), "spans")

    groups = spans.groupBy("key").agg(F.count("*").alias("size"))
    large = stored(groups.where(F.col("size") > LARGE_GROUP).select("key"), "large")
    wanted = spans.groupBy("doc").agg(F.collect_list(F.struct("key", "start", "windows", "place", "n")).alias("wanted"))
    wanted = stored(wanted, "wanted")
    pieces = with_lists(named.select("doc", "text"), wanted).mapInArrow(_cut_out(length), "doc long, key long, start long, windows int, place int, n long, bytes binary")
    pieces = stored(pieces, "pieces")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = pieces.join(large, "key", "left_anti").repartition(tasks, "key").sortWithinPartitions("key")
    ranges = small.mapInArrow(_columns(length), "doc long, begin long, stop long")
    alone = pieces.join(large, "key", "left_semi").mapInArrow(_single_windows(length), "doc long, key long, begin long, hash long, n long")
    alone = stored(alone, "single-windows")
    twice = alone.groupBy("key", "hash").agg(F.count("*").alias("many")).where("many > 1").select("key", "hash")
    alone = alone.where("n = 1").join(twice, ["key", "hash"], "left_semi")
    ranges = ranges.unionByName(alone.select("doc", "begin", (F.col("begin") + length).alias("stop")))

    whole = again.where("not mixed").select("doc", F.col("start").alias("begin"), end.alias("stop"))
    equal = mixed.join(spans.where("n > 1").select("key", "span"), ["key", "span"], "left_semi")
    ranges = ranges.unionByName(whole).unionByName(equal.select("doc", F.col("start").alias("begin"), end.alias("stop")))
    ranges = ranges.groupBy("doc").agg(F.collect_set(F.struct("begin", "stop")).alias("ranges"))
    marks = stored(ranges.mapInArrow(_merged, "doc long, ranges array<struct<begin:long,stop:long>>"), "marks")
    joined = with_lists(named, marks, every=True).select("id", "text", "ranges")
    id_type = source.schema["id"].dataType
    schema = pa.schema(
        [("id", to_arrow_type(id_type)), ("n_bytes", pa.int64()), ("kept", pa.binary()),
         ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())])))]
    )
    out = joined.mapInArrow(_removed(schema), f"id {id_type.simpleString()}, n_bytes long, kept binary, spans array<struct<begin:long,stop:long>>")
    return out.withColumnRenamed("id", id_col)
