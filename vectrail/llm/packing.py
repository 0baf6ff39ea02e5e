"""Best-fit packing of token sequences: bounded-space online best-fit.

Every task keeps a fixed number of open sequences, in a bitset keyed by free space. A piece goes
to the open sequence it fits best; when all are open and none fits, the fullest closes. Pieces are
held back until their sequence closes. What is open at the end of a task is packed again, as wholes,
in a second round; only these pieces ever meet the table that says where they went.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .scratch import stored

SEQUENCE = 1024
OPEN_BINS = 1024
END_ID = 2
LEFT_PER_TASK = 1 << 15
ROWS_OUT = 4096


class BestFit:
    """Open bins by free space: bit f of ``mask`` is set when a bin with f free places is open."""

    def __init__(self, capacity: int, most: int, first: int):
        self.capacity, self.most, self.next = capacity, most, first
        self.mask, self.count = 0, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.closed: list[int] = []

    def put(self, need: int) -> tuple[int, int]:
        """(bin, offset) for an item of 1 to ``capacity`` places."""
        fitting = self.mask >> need
        if fitting:
            free = need + (fitting & -fitting).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self.count == self.most:
                self.closed.append(self._take((self.mask & -self.mask).bit_length() - 1))
            bin_id, free = self.next, self.capacity
            self.next += 1
        if free > need:
            self.bins[free - need].append(bin_id)
            self.mask |= 1 << (free - need)
            self.count += 1
        else:
            self.closed.append(bin_id)
        return bin_id, self.capacity - free

    def _take(self, free: int) -> int:
        bin_id = self.bins[free].pop()
        if not self.bins[free]:
            self.mask &= ~(1 << free)
        self.count -= 1
        return bin_id

    def open(self) -> dict[int, int]:
        """Used places of every open bin."""
        return {b: self.capacity - free for free, bins in enumerate(self.bins) for b in bins}


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a text's pieces: whole if it fits, else full pieces after a shorter first one."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity
    starts = ([0] if first else []) + list(range(first, length, capacity))
    return [(s, e - s) for s, e in zip(starts, starts[1:] + [length])]


def _pieces(tokenizer: str, ranks: str | None, end_id: int, capacity: int, most: int, schema: pa.Schema):
    def run(batches):
        encoder = tokens.PieceEncoder(tokenizer, ranks)
        packer = BestFit(capacity, most, TaskContext.get().partitionId() << 40)
        held: dict[int, list[tuple]] = {}  # pieces of the open sequences: at most ``most`` times ``capacity`` ids
        done: list[tuple] = []
        for batch in batches:
            keys = batch.column("key").to_pylist()
            for row, found in encoder.texts(batch.column("text")):
                whole = np.append(found, np.uint32(end_id)).astype("<u4")
                for k, (s, n) in enumerate(cuts(len(whole), capacity)):
                    bin_id, offset = packer.put(n)
                    held.setdefault(bin_id, []).append((keys[row], k, s, n, whole[s : s + n].tobytes(), bin_id, offset, False))
                for bin_id in packer.closed:
                    done += held.pop(bin_id)
                packer.closed.clear()
                if len(done) >= ROWS_OUT:
                    yield _batch(done, schema)
                    done = []
        done += [(*piece[:-1], True) for pieces in held.values() for piece in pieces]
        for i in range(0, len(done), ROWS_OUT):
            yield _batch(done[i : i + ROWS_OUT], schema)

    return run


def _batch(pieces: list[tuple], schema: pa.Schema):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*pieces), schema)], schema=schema)


def _repack(capacity: int, most: int):
    def run(batches):
        packer = BestFit(capacity, most, (1 << 62) + (TaskContext.get().partitionId() << 40))
        for batch in batches:
            to = [packer.put(n) for n in batch.column("used").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("bin"), pa.array([b for b, _ in to], pa.int64()), pa.array([o for _, o in to], pa.int32())],
                names=["bin", "to_bin", "shift"],
            )

    return run


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "byte_bpe_50k.json",
    ranks: str | None = "byte_bpe_50k.tiktoken",
    end_id: int = END_ID,
    capacity: int = SEQUENCE,
    open_bins: int = OPEN_BINS,
) -> DataFrame:
    """Pieces of all texts with their token ids, packed into sequences of at most ``capacity`` tokens.

    One row per piece: ``id_col, piece, start, length, ids`` (little-endian 32-bit), ``sequence_id,
    offset``. A text's ids are the tokenizer's, then ``end_id``; only a longer text is cut, into full
    pieces after a first that may be shorter. A null or empty text is the end id alone. Repeated rows
    are packed once per row; a null id is passed on. No rows give no rows. Other columns are ignored,
    whatever their names. Offsets in a sequence leave no gap.

    The tokens are computed once and stored. Nothing but the pieces of sequences left open, at most
    ``open_bins`` a task, is moved: they are packed again, ``LEFT_PER_TASK`` sequences at a time.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    ddl = f"key {source.schema['key'].dataType.simpleString()}, piece int, start long, length long, ids binary, bin long, offset long, open boolean"
    schema = pa.schema(
        [
            ("key", _arrow_type(source)),
            ("piece", pa.int32()),
            ("start", pa.int64()),
            ("length", pa.int64()),
            ("ids", pa.binary()),
            ("bin", pa.int64()),
            ("offset", pa.int64()),
            ("open", pa.bool_()),
        ]
    )
    first = stored(source.mapInArrow(_pieces(tokenizer, ranks, end_id, capacity, open_bins, schema), ddl), "packed")
    left = first.where("open").groupBy("bin").agg(F.sum("length").alias("used"))
    left = stored(left, "left-open")
    tasks = max(1, -(-left.count() // LEFT_PER_TASK))
    moved = left.repartition(tasks).sortWithinPartitions(F.desc("used"), "bin")
    moved = stored(moved.mapInArrow(_repack(capacity, open_bins), "bin long, to_bin long, shift int"), "repacked")
    placed = ["key", "piece", "start", "length", "ids"]
    closed = first.where("not open").select(*placed, F.col("bin").alias("sequence_id"), "offset")
    again = first.where("open").join(moved, "bin").select(*placed, F.col("to_bin").alias("sequence_id"), (F.col("offset") + F.col("shift")).alias("offset"))
    return closed.unionByName(again).withColumnRenamed("key", id_col)


def _arrow_type(source: DataFrame):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(source.schema["key"].dataType)


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
