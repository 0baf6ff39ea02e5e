"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

Built-in functions only. A window as long as a benchmark item is laid wherever a document shares a
shingle with it, so that the shingle lies at the same word of both; a window that shares none has
similarity 0. Near the ends of a text, all windows that the end cuts are laid too. Its 64-bit SimHash is cut into ``RADIUS + 1`` blocks: fingerprints at most ``RADIUS``
bits apart agree in a block, so joining block by block finds them all. Pairs within the radius are
compared by the weighted Jaccard similarity of their shingles, the weight being the multiplicity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored

WORDS = 5
PERCENT = 80
BITS = 64
RADIUS = 24  # at similarity 0.8 the expected distance is 9.7 bits, the deviation 2.9
SPACE = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Lower-cased words; none for a null or blank text."""
    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def grams(words: Column, size: int, stride: int = 1) -> Column:
    """Hashes of the runs of ``size`` words that start at every ``stride``-th word."""
    starts = F.sequence(F.lit(1), F.size(words) - (size - 1), F.lit(stride))
    found = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, size)))
    return F.when(F.size(words) >= size, found).otherwise(F.array().cast("array<bigint>"))


def shingles(words: Column, size: int = WORDS) -> Column:
    """All shingles, repeats included; a shorter sequence is one shingle, an empty one none."""
    return (
        F.when(F.size(words) >= size, grams(words, size))
        .when(F.size(words) > 0, F.array(F.xxhash64(words)))
        .otherwise(F.array().cast("array<bigint>"))
    )


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def simhash(found: Column) -> Column:
    """64 bits, each the majority of that bit among the shingles."""

    def bit(total, b):
        ones = F.aggregate(found, F.lit(0), lambda s, h: s + F.call_function("shiftright", h, b).bitwiseAND(F.lit(1)).cast("int"))
        return total.bitwiseOR(F.call_function("shiftleft", (ones * 2 > F.size(found)).cast("bigint"), b))

    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("bigint"), bit)


def blocks_of(fingerprint: Column, radius: int) -> Column:
    """``radius + 1`` structs (block, value) that cover the fingerprint."""
    n = radius + 1
    edges = [BITS * k // n for k in range(n + 1)]
    return F.array(
        *[
            F.struct(
                F.lit(k).alias("block"),
                F.shiftright(fingerprint, edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1)).alias("value"),
            )
            for k in range(n)
        ]
    )


def weighted(found: Column) -> Column:
    """Distinct elements (shingle, occurrence), so that set similarity weighs by multiplicity."""
    return bound(
        F.array_sort(found),
        lambda a: F.transform(a, lambda x, i: F.xxhash64(x, (i + 1 - F.array_position(a, x)).cast("long"))),
    )


def lossless_stride(sizes: list[int], percent: int = PERCENT) -> int:
    """How far apart seeds may start so that none with the needed similarity is missed.

    With w positions of a window unshared, at least max(w * percent / (100 - percent),
    (s + w) * percent / 100) of the s shingles are shared, in at most w + 1 runs; the longest run
    must not fit between two seeds.
    """
    least = 4
    for s in set(sizes):
        for w in range(s + 1):
            shared = max(-(-w * percent // (100 - percent)), -(-(s + w) * percent // 100))
            if shared > s:
                break
            least = min(least, max(1, -(-shared // (w + 1))))
    return least


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    percent: int = PERCENT,
    radius: int = RADIUS,
) -> DataFrame:
    """(``id_col``, ``item_col``, n_windows, similarity, first_word) of every item found in a document.

    A window has as many words as the item, fewer at the ends of the text; it holds the item when the
    weighted Jaccard similarity of their five-word shingles is at least ``percent`` / 100. Items of
    fewer than five words are a single shingle of their own length. ``first_word`` is the first word,
    from 0, of the earliest such window, ``similarity`` the best. Items and texts without words match
    nothing, null ids are passed on, repeated rows and items are judged each, extra columns are
    ignored. Empty inputs give no rows.

    Documents are hashed once, without a shuffle, against the items' shingles. Only windows laid on
    a shared shingle move, and equal windows are fingerprinted once, however many documents hold them.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), words_of(F.col(item_text_col)).alias("words"))
    items = stored(items.where(F.size("words") > 0).distinct(), "items")
    items = items.withColumn("m", F.size("words")).withColumn("least", F.least(F.col("m"), F.lit(WORDS)))
    sizes = [(r.least, r.m) for r in items.groupBy("least").agg(F.min("m").alias("m")).collect()]
    counts = [r.m - WORDS + 1 for r in items.where(F.col("m") >= WORDS).select("m").distinct().collect()]
    stride = lossless_stride(counts, percent) if counts else 1
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    steps = {least: stride if least == WORDS else 1 for least, _ in sizes}

    def seeds(words):
        return F.array(
            *[F.struct(F.lit(g).alias("g"), F.lit(s).alias("step"), grams(words, g, s).alias("hashes")) for g, s in steps.items()]
        )

    if not sizes:
        steps = {WORDS: 1}
    spots = docs.select("doc_id", F.explode(bound(words_of(F.col("text")), seeds)).alias("s"))
    spots = spots.select("doc_id", "s.g", "s.step", F.posexplode("s.hashes").alias("k", "h"))
    spots = spots.select("doc_id", "g", "h", (F.col("k") * F.col("step") + 1).alias("at"))
    keys = items.select(
        "item_id",
        F.col("least").alias("g"),
        F.posexplode(shingles(F.col("words"))).alias("offset", "h"),
    )
    keys = stored(keys, "item-shingles")
    windows = spots.join(keys, ["g", "h"]).select("doc_id", (F.col("at") - F.col("offset")).alias("start"), "item_id").distinct()
    places = windows.join(F.broadcast(items.select("item_id", "m")) if _small(items) else items.select("item_id", "m"), "item_id")
    per_doc = places.groupBy("doc_id").agg(F.collect_set(F.struct("start", "m", "item_id")).alias("places"))
    per_doc = stored(per_doc, "windows").withColumnRenamed("doc_id", "place_id")
    laid = docs.join(per_doc, docs["doc_id"].eqNullSafe(per_doc["place_id"]))

    def lay(words):
        none = F.array().cast("array<int>")

        def starts(p):
            # Windows that an end of the text cuts are laid wherever they can still reach ``percent``.
            spare = F.floor((p["m"] - WORDS + 1) * (100 - percent) / 100).cast("int")
            last = F.size(words) - p["m"] + 1
            at_start = F.when((spare > 0) & (p["start"] <= p["m"]), F.sequence(1 - spare, F.lit(0))).otherwise(none)
            at_end = F.when((spare > 0) & (p["start"] + p["m"] > last), F.sequence(last + 1, last + spare)).otherwise(none)
            return F.concat(F.array(p["start"]), at_start, at_end)

        def cut(p, start):
            first = F.greatest(start, F.lit(1))
            length = F.least(start + p["m"] - 1, F.size(words)) - first + 1
            return F.struct(p["item_id"].alias("item_id"), first.alias("first"), length.alias("length"))

        def one(w):
            return F.struct(w["item_id"].alias("item_id"), w["first"].alias("first"), shingles(F.slice(words, w["first"], w["length"])).alias("shingles"))

        cuts = F.flatten(F.transform(F.col("places"), lambda p: F.transform(starts(p), lambda start: cut(p, start))))
        return F.transform(F.array_distinct(F.filter(cuts, lambda w: w["length"] > 0)), one)

    laid = laid.select("doc_id", F.explode(bound(words_of(F.col("text")), lay)).alias("w")).select("doc_id", "w.*")
    laid = laid.withColumn("content", F.sha2(F.array_join(F.col("shingles").cast("array<string>"), " "), 256))
    laid = stored(laid, "laid")
    distinct = laid.groupBy("item_id", "content").agg(F.first("shingles").alias("shingles"))
    fingerprint = simhash(F.col("shingles"))
    distinct = stored(distinct.withColumn("fingerprint", fingerprint), "window-prints")
    prints = items.select("item_id", shingles(F.col("words")).alias("item_shingles")).withColumn("item_print", simhash(F.col("item_shingles")))
    prints = stored(prints, "item-prints")
    cut = distinct.select("item_id", "content", "fingerprint", F.inline(blocks_of(F.col("fingerprint"), radius)))
    item_cut = prints.select("item_id", "item_print", F.inline(blocks_of(F.col("item_print"), radius)))
    near = cut.join(item_cut, ["item_id", "block", "value"])
    near = near.where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print"))) <= radius)
    near = near.select("item_id", "content", "item_print").distinct()
    both = near.join(distinct.select("item_id", "content", "shingles"), ["item_id", "content"]).join(prints, ["item_id", "item_print"])
    both = both.select("item_id", "content", weighted(F.col("shingles")).alias("a"), weighted(F.col("item_shingles")).alias("b"))
    both = both.withColumn("shared", F.size(F.array_intersect("a", "b"))).withColumn("all", F.size("a") + F.size("b") - F.col("shared"))
    held = both.where(F.col("shared") * 100 >= F.col("all") * percent)
    held = held.groupBy("item_id", "content").agg(F.max(F.col("shared") / F.col("all")).alias("similarity"))
    found = laid.select("doc_id", "item_id", "first", "content").join(stored(held, "leaks"), ["item_id", "content"])
    return found.groupBy(F.col("doc_id").alias(id_col), F.col("item_id").alias(item_col)).agg(
        F.countDistinct("first").alias("n_windows"),
        F.max("similarity").alias("similarity"),
        (F.min("first") - 1).cast("int").alias("first_word"),
    )


def _small(items: DataFrame) -> bool:
    """Whether the benchmark's ids may be broadcast: at most a hundred thousand items."""
    return items.count() <= 100_000
