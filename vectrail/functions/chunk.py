"""Splitting one text into chunks under a token budget.

Every chunker maps text to ``array<string>``. Words are packed by one regular expression;
huge budgets, and paragraphs, by a fold over the pieces that carries only where chunks
start, after which the piece array is cut once per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import bind, collapse_spaces, strip, words


# Pieces folded before their chunk starts join the others: appending copies the array, so
# one level alone would be quadratic in the number of chunks of a text.
BLOCK = 1000


def _starts(pieces: Column, cost, budget: int) -> Column:
    """1-based index of the piece that opens each chunk.

    The running cost begins above the budget, so the first piece always opens a chunk;
    a piece dearer than the whole budget becomes a chunk of its own.
    """
    nothing = F.array().cast("array<int>")

    def step(state, piece):
        used = state["used"] + cost(piece)
        following = (state["at"] + 1).alias("at")
        fits = F.struct(following, used.alias("used"), state["starts"].alias("starts"))
        opens = F.struct(
            following,
            cost(piece).cast("bigint").alias("used"),
            F.concat(state["starts"], F.array(state["at"])).alias("starts"),
        )
        return F.when(used <= budget, fits).otherwise(opens)

    def block(state, begin):
        opened = F.struct(begin.alias("at"), state["used"].alias("used"), nothing.alias("starts"))
        return bind(
            F.aggregate(F.slice(pieces, begin, F.lit(BLOCK)), opened, step),
            lambda inner: F.struct(
                inner["used"].alias("used"),
                F.concat(state["starts"], inner["starts"]).alias("starts"),
            ),
        )

    begins = F.sequence(F.lit(1), F.greatest(F.size(pieces), F.lit(1)), F.lit(BLOCK))
    start = F.struct(F.lit(budget + 1).cast("bigint").alias("used"), nothing.alias("starts"))
    return F.aggregate(begins, start, block, lambda state: state["starts"])


def pack(pieces: Column, cost, budget: int) -> Column:
    """Greedy packing of ``pieces`` in order; chunks are joined by one space."""
    if budget <= 0:
        return F.array().cast("array<string>")

    def cut(items):
        def one(starts):
            return F.transform(
                starts,
                lambda at, i: F.array_join(
                    F.slice(items, at, F.coalesce(F.get(starts, i + 1), F.size(items) + 1) - at), " "
                ),
            )

        return bind(_starts(items, cost, budget), one)

    return bind(pieces, cut)


# The pattern below nests one match per block of tokens and per token of the rest. A default
# 1 MB thread stack was seen to hold 1024 of them in a cold JVM; under half of that is allowed.
TOKEN_BLOCK = 64
PATTERN_BUDGET = 320 * TOKEN_BLOCK


def _word_pattern(budget: int) -> str:
    """The longest run of whole words worth at most ``budget`` tokens, each word followed by
    one space.

    A word costs one token per four characters of itself and its space. So reading from a
    word's start, a token is three non-spaces and any character, and up to two non-spaces
    and a space close the word for free. A word above the budget stands alone.

    Tokens are taken in whole blocks first, then singly; the single ones are enough to fill
    a block, so stepping back from the middle of a word passes over no word's end.
    """
    oversize = rf"[^ ]{{{4 * budget + 3},}} "
    free = r"(?:[^ ]{0,2} )*+"
    token = rf"{free}[^ ]{{3}}."
    blocks = max(0, (budget - TOKEN_BLOCK + 1) // TOKEN_BLOCK)
    singles = budget - blocks * TOKEN_BLOCK
    taken = rf"(?:(?:{token}){{{TOKEN_BLOCK}}}+){{0,{blocks}}}(?:{token}){{0,{singles}}}"
    return rf"(?s){oversize}|(?=[^ ]){taken}{free}(?<= )"


def word_chunks(text: Column, budget: int) -> Column:
    """G1: pack words; a word costs a quarter of its length with its trailing space."""
    if 0 < budget <= PATTERN_BUDGET:
        spaced = F.concat(collapse_spaces(F.coalesce(text, F.lit(""))), F.lit(" "))
        found = F.regexp_extract_all(spaced, F.lit(_word_pattern(budget)), F.lit(0))
        return F.transform(found, lambda chunk: F.rtrim(chunk))
    return pack_words(text, budget)


def pack_words(text: Column, budget: int) -> Column:
    """G1 for any budget, word by word."""
    return pack(words(text), lambda word: F.shiftright(F.length(word) + 1, 2), budget)


def paragraph_chunks(text: Column, budget: int) -> Column:
    """Pack paragraphs (parted by blank lines); each costs at least one token."""
    paragraphs = F.array_remove(
        F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), strip), ""
    )
    return pack(
        paragraphs,
        lambda p: F.greatest(F.lit(1), F.shiftright(F.length(p) + 1, 2)),
        budget,
    )


def fixed_chunks(text: Column, budget: int) -> Column:
    """Consecutive slices of four characters per token.

    One regular-expression pass; cutting by position would rescan the text per slice.
    """
    if budget <= 0:
        return F.array().cast("array<string>")
    return F.regexp_extract_all(
        F.coalesce(text, F.lit("")), F.lit(rf"(?s).{{1,{budget * 4}}}"), F.lit(0)
    )


def explode_chunks(df: DataFrame, chunks: Column, *keep: str) -> DataFrame:
    """One row per chunk: the kept columns, ``chunk_index`` from 0, and ``chunk``."""
    return df.select(*keep, F.posexplode(chunks).alias("chunk_index", "chunk"))


def chunk_id(doc_id: Column, chunk_index: Column) -> Column:
    """Content-derived id, so a retried job yields the same messages."""
    return F.md5(F.concat_ws(":", doc_id.cast("string"), chunk_index.cast("string")))

