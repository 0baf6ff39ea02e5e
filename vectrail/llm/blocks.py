"""Texts as numpy arrays inside tasks: byte blocks, word and shingle hashes, sorted groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19
_SEED = 0x5EED
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = np.random.default_rng(_SEED).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly; a bijection."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse, modulo 2**64; grown on demand."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, BLOCK_BYTES + (1 << 16))
        inverse = pow(int(_BASE), -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", np.uint64(inverse))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["up"], _POWERS["down"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] the polynomial of data[i:j], before it is shifted to position 0."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each data[start:end] that depends on its bytes and length only."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) in runs of rows of about ``most`` bytes; a longer text is alone."""
    data, offsets = buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word [^\\x20\\x09-\\x0D]+ after A-Z are lowered, and the first word of each text (plus the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside & (first[:n] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (first[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    hashes = range_hash(prefix_hash(_LOWER[data]), starts, ends)
    return hashes, np.searchsorted(starts, offsets)


_FACTORS = (np.random.default_rng(_SEED + 1).integers(1, 1 << 63, 16, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes); a text of fewer words is one shingle, one without words has none."""
    for row, end, data, offsets in byte_blocks(column):
        hashes, at = words(data, offsets)
        n = len(hashes)
        runs = np.zeros(0, np.uint64)
        if n >= size:
            runs = np.zeros(n - size + 1, np.uint64)
            for k in range(size):
                runs += hashes[k : n - size + 1 + k] * _FACTORS[k]
            runs = mix(runs)
        for i in range(end - row):
            a, b = int(at[i]), int(at[i + 1])
            if b - a >= size:
                yield row + i, np.unique(runs[a : b - size + 1])
            elif b > a:
                short = (hashes[a:b] * _FACTORS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield row + i, mix(np.array([short], np.uint64))
            else:
                yield row + i, runs[:0]


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that end where the key changes, from rows that come sorted by ``keys``.

    Each holds many whole groups; only a group longer than a batch makes one grow.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.num_rows
        differs = np.zeros(batch.num_rows, bool)
        for key in keys:
            column = batch.column(key)
            if pa.types.is_integer(column.type):
                values = column.to_numpy(zero_copy_only=False)
                differs |= values != values[-1]
            else:
                final = column[-1].as_py()
                differs |= np.array([x != final for x in column.to_pylist()], bool)
        whole = np.flatnonzero(differs)
        last = int(whole[-1]) + 1 if len(whole) else 0
        if last:
            held.append(batch.slice(0, last))
            yield pa.Table.from_batches(held)
            held = [batch.slice(last)]
        elif held and _same(held[-1], batch, keys):
            held.append(batch)
        else:
            if held:
                yield pa.Table.from_batches(held)
            held = [batch]
    if held:
        yield pa.Table.from_batches(held)


def _same(left: pa.RecordBatch, right: pa.RecordBatch, keys: list[str]) -> bool:
    return all(left.column(k)[-1].as_py() == right.column(k)[0].as_py() for k in keys)


def arrow_task(body: Callable, *given) -> Callable:
    """A function for mapInArrow that calls ``body(batch, *given)`` for each batch and passes on what it yields."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from body(batch, *given)

    return run
