"""Content-chosen anchors: every window of bytes is governed by one short string inside it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import blocks

GRAM = 64
UNIT_BYTES = 8 << 20
_PLACE = np.uint64((1 << 24) - 1)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _units(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, unit offsets, row of each unit, its first byte in the text); long texts come as overlapping units."""
    for row, end, data, offsets in blocks.byte_blocks(column):
        if len(data) <= UNIT_BYTES:
            yield data, offsets, np.arange(row, end), np.zeros(end - row, np.int64)
            continue
        for at in range(0, max(1, len(data) - length + 1), UNIT_BYTES):
            part = data[at : at + UNIT_BYTES + length - 1]
            yield part, np.array([0, len(part)]), np.array([row]), np.array([at])


def governed(column: pa.Array, length: int, gram: int = GRAM) -> Iterator[dict[str, np.ndarray]]:
    """Runs of neighbouring windows of ``length`` bytes that have the same anchor.

    The anchor of a window is its ``gram``-byte string with the smallest hash, the first if it repeats.
    It depends on the window's bytes only, so equal windows have equal anchors at equal places.
    """
    width = length - gram + 1
    for data, offsets, rows, base in _units(column, length):
        n = len(data)
        sizes = np.diff(offsets)
        valid = np.zeros(n + 1, np.int32)
        long = sizes >= length
        if not long.any():
            continue
        np.add.at(valid, offsets[:-1][long], 1)
        np.add.at(valid, offsets[1:][long] - length + 1, -1)
        starts = np.flatnonzero(np.cumsum(valid[:n]) > 0)
        prefix = blocks.prefix_hash(data)
        _, down = blocks.powers(n + 1)
        grams = blocks.mix((prefix[gram:] - prefix[:-gram]) * down[: n - gram + 1] + np.uint64(gram))
        least = sliding_min(grams & ~_PLACE | np.arange(len(grams), dtype=np.uint64), width)[starts]
        anchor = (least & _PLACE).astype(np.int64)
        unit = np.searchsorted(offsets, starts, "right") - 1
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (unit[1:] != unit[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(starts)) - 1
        lo, hi, at, unit = starts[first], starts[last], anchor[first], unit[first]
        span = blocks.range_hash(prefix, lo, hi + length)
        yield {
            "row": rows[unit],
            "key": grams[at].view(np.int64),
            "span": blocks.mix(span + (at - lo).astype(np.uint64)).view(np.int64),
            "start": lo - offsets[unit] + base[unit],
            "windows": hi - lo + 1,
            "place": at - lo,
        }
