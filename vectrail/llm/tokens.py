"""Token ids of whole texts by a public tokenizer file, with every distinct piece of text tokenised once per worker."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa

from . import blocks

KNOWN_PIECES = 400_000
KNOWN_IDS = 4_000_000
# White space that is more than one byte long in UTF-8, and control characters some patterns count as such.
_ODD_SPACE = re.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x1c-\x1f]")

# White space 1, what ends a run of letters 2 (digits, and marks but for the apostrophe of contractions), letters 3.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 2
_KIND[ord("'")] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = 3
_KIND[[0x20, *range(0x09, 0x0E)]] = 1


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def _load(name: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


@lru_cache(maxsize=4)
def _load_ranks(name: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(tokenizer_path(name), "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class PieceEncoder:
    """Ids of texts, piece by piece.

    The tokenizer's pattern never lets a token run from a non-space into the white space after
    it, nor from a letter into a digit or mark, so a text's ids are those of its pieces one after
    another. Pieces repeat far more often than texts do. Texts with odd white space or a special
    token go to the tokenizer whole. What is remembered is bounded; a full memory is emptied.
    ``ranks`` may name the same vocabulary as a rank file, which encodes a piece in a fraction of the time.
    """

    def __init__(self, name: str, ranks: str | None = None):
        self.tokenizer = _load(name)
        self.ranks = _load_ranks(ranks) if ranks else None
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.lengths, self.ids = np.zeros(1 << 16, np.int64), np.zeros(1 << 19, np.uint32)
        self.starts, self.used = np.zeros(1 << 16, np.int64), 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, hashes: list[int], texts: list[str]) -> None:
        if self.ranks:
            encoded = list(map(self.ranks.encode_ordinary, texts))
        else:
            encoded = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        flat = np.array(list(chain.from_iterable(encoded)), np.uint32)
        lengths = np.array(list(map(len, encoded)), np.int64)
        n, end, used = len(self.known), len(self.known) + len(hashes), self.used + len(flat)
        while end > len(self.starts):
            self.starts, self.lengths = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.lengths))
        while used > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.used : used] = flat
        self.lengths[n:end] = lengths
        self.starts[n:end] = self.used + np.cumsum(lengths) - lengths
        self.known.update(zip(hashes, range(n, end)))
        self.used = used

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block end to end, and where each text's begin (plus the end)."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        kind = _KIND[data]
        begin = np.zeros(n + 1, bool)
        begin[1:n] = (kind[1:] == 1) & (kind[:-1] != 1) | (kind[1:] == 2) & (kind[:-1] == 3)
        begin[offsets[:-1][offsets[:-1] < n]] = True
        starts = np.flatnonzero(begin[:n])
        ends = np.append(starts[1:], n)
        hashes = blocks.range_hash(blocks.prefix_hash(data), starts, ends)
        which, distinct = pd.factorize(hashes)
        distinct = distinct.tolist()
        if len(self.known) > KNOWN_PIECES or self.used > KNOWN_IDS:
            self.forget()
        get = self.known.get
        at = np.array([get(h, -1) for h in distinct], np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            first = np.zeros(len(distinct), np.int64)
            first[which[::-1]] = np.arange(len(which))[::-1]
            raw, a, b = data.tobytes(), starts[first[new]].tolist(), ends[first[new]].tolist()
            at[new] = len(self.known) + np.arange(len(new))
            self._learn([distinct[i] for i in new], [raw[i:j].decode() for i, j in zip(a, b)])
        at = at[which]
        lengths = self.lengths[at]
        total = np.concatenate(([0], np.cumsum(lengths)))
        index = np.arange(total[-1]) + np.repeat(self.starts[at] - total[:-1], lengths)
        return self.ids[index], total[np.searchsorted(starts, offsets)]

    def texts(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) of every text; null counts as empty."""
        for row, end, data, offsets in blocks.byte_blocks(column):
            odd = np.zeros(end - row, bool)
            raw = data.tobytes().decode()
            if _ODD_SPACE.search(raw) or (self.special and self.special.search(raw)):
                for i in range(end - row):
                    text = data[offsets[i] : offsets[i + 1]].tobytes().decode()
                    odd[i] = bool(_ODD_SPACE.search(text) or (self.special and self.special.search(text)))
            ids, at = self.block(data, offsets)
            for i in range(end - row):
                if odd[i]:
                    yield row + i, self.whole(data[offsets[i] : offsets[i + 1]].tobytes().decode())
                else:
                    yield row + i, ids[at[i] : at[i + 1]]
