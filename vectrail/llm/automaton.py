"""Language-model scoring by a weighted backoff automaton over words.

States are the empty history (the root) and every word learned from. A state has an arc for each word
seen at least ``MIN_ARC`` times after it, with the discounted, interpolated log-probability, and a
failure arc to the root whose weight is the mass the discount left (1 for a state without arcs). The
root has an arc for every word. A text is read once from left to right: from the state of the last
word take the arc if there is one, else fail to the root and take the root's.

Counts never meet in one place. Documents are dealt to blocks of bounded size by a hash. A block sends
its distinct words, and its word pairs, as sorted lists of hashes cut into ranges; a range adds up what
all blocks sent and answers each list in its order, so totals go back without keys. The first block
that holds a pair adds it to its history's mass. Lists travel as differences, byte plane by byte plane.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import new_scratch
from . import blocks
from .scratch import stored

BLOCK_BYTES = 24 << 20
MIN_ARC = 2
DISCOUNT = 0.6
END = np.uint64(0x45B4D9A10E5F00D1)
_LEFT, _RIGHT = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)
_SENT = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_PAIRS = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("totals", pa.binary())])
_MASSES = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("followed", pa.binary()), ("arcs", pa.binary())])
_WORDS = pa.schema(
    [("block", pa.int32()), ("part", pa.int32()), ("totals", pa.binary()), ("followed", pa.binary()), ("arcs", pa.binary()),
     ("tokens", pa.int64()), ("words", pa.int64())]
)


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {({'int32': 'int', 'int64': 'long'}).get(str(f.type), str(f.type))}" for f in schema)


def _packed(values: np.ndarray) -> bytes:
    """Values that are not negative: their width, then their bytes from lowest to highest, one plane for each."""
    wide = np.ascontiguousarray(values).astype("<u8")
    width = max(1, -(-int(wide.max(initial=0)).bit_length() // 8))
    return bytes([width]) + wide.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8)[1:].reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view("<u8").ravel()


def _packed_keys(keys: np.ndarray) -> bytes:
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _unpacked_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(raw), dtype=np.uint64)


def _ranges(keys: np.ndarray, parts: int):
    """(part, slice) of sorted keys for every part that has any."""
    of = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    edges = np.searchsorted(of, np.arange(parts + 1, dtype=np.uint64))
    for part in np.flatnonzero(np.diff(edges)):
        yield int(part), slice(edges[part], edges[part + 1])


def arc_key(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    return blocks.mix(history * _LEFT + blocks.mix(word + _RIGHT))


def _tokens(column: pa.Array):
    """For runs of rows: (first row, tokens of all their texts with an end after each, start of each text plus the end)."""
    for row, end, data, offsets in blocks.byte_blocks(column):
        hashes, at = blocks.words(data, offsets)
        n = end - row
        out = np.full(len(hashes) + n, END, np.uint64)
        inside = np.ones(len(out), bool)
        starts = at + np.arange(n + 1)
        inside[starts[1:] - 1] = False
        out[inside] = hashes
        yield row, out, starts


def _histories(tokens: np.ndarray) -> np.ndarray:
    """The token before each; a text starts after an end."""
    return np.concatenate((np.array([END], np.uint64), tokens[:-1]))


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
    return distinct, np.bincount(which, weights=weights, minlength=len(distinct)).astype(np.int64), first


def _word_counts(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of a block, sorted, and how often each is to be learned."""
    train = table.column("train").to_numpy()
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for row, tokens, starts in _tokens(table.column("text")):
        weight = np.repeat(train[row : row + len(starts) - 1], np.diff(starts)).astype(np.float64)
        k, c, _ = _summed(tokens, weight)
        keys, counts = np.concatenate((keys, k)), np.concatenate((counts, c))
    return _summed(keys, counts)[:2]


def _pair_counts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of a block, sorted by key, how often each is to be learned, and their histories."""
    train = table.column("train").to_numpy()
    parts = [[np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]]
    for row, tokens, starts in _tokens(table.column("text")):
        weight = np.repeat(train[row : row + len(starts) - 1], np.diff(starts)).astype(np.float64)
        before = _histories(tokens)
        k, c, first = _summed(arc_key(before, tokens), weight)
        for part, new in zip(parts, (k, before[first], c)):
            part.append(new)
    keys, histories, counts = (np.concatenate(p) for p in parts)
    keys, counts, first = _summed(keys, counts)
    return keys, counts, histories[first]


def _sent(counted, parts: int):
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        keys, counts = counted(table)[:2]
        rows = [(part, block, _packed_keys(keys[at]), _packed(counts[at])) for part, at in _ranges(keys, parts)]
        return _table(rows, _SENT)

    return run


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _received(table: pa.Table):
    """What blocks sent to a range, by block: blocks, ends of lists, distinct keys, totals, first holder and place of each key."""
    table = table.sort_by("block")
    lists = [_unpacked_keys(k.as_py()) for k in table.column("keys")]
    counts = np.concatenate([_unpacked(c.as_py()) for c in table.column("counts")])
    distinct, first, which = np.unique(np.concatenate(lists), return_index=True, return_inverse=True)
    totals = np.bincount(which, weights=counts.astype(np.float64), minlength=len(distinct)).astype(np.int64)
    return table.column("block").to_pylist(), np.cumsum([len(k) for k in lists])[:-1], distinct, totals, first, which


def _pair_totals(table: pa.Table) -> pa.Table:
    """To each block twice the total of each of its arcs, plus one in the block that counts it; 0 for other pairs."""
    part = table.column("part")[0].as_py()
    own, ends, _, totals, first, which = _received(table)
    totals = np.where(totals >= MIN_ARC, totals, 0)
    answers = 2 * totals[which]
    answers[first[totals > 0]] += 1
    return _table([(b, part, _packed(a)) for b, a in zip(own, np.split(answers, ends))], _PAIRS)


def _aligned(answers: pa.Table, column: str) -> np.ndarray:
    """The answers to a block's whole sorted list."""
    lists = [_unpacked(a.as_py()) for a in answers.sort_by("part").column(column)]
    return np.concatenate([np.zeros(0, np.uint64), *lists]).astype(np.int64)


def _masses(parts: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _MASSES.empty_table()
        _, _, histories = _pair_counts(docs)
        totals = _aligned(answers, "totals")
        counted = (totals & 1).astype(bool)
        keys, which = np.unique(histories[counted], return_inverse=True)
        arcs = np.bincount(which, minlength=len(keys))
        followed = np.bincount(which, weights=(totals[counted] >> 1).astype(np.float64), minlength=len(keys)).astype(np.int64)
        return _table([(p, _packed_keys(keys[at]), _packed(followed[at]), _packed(arcs[at])) for p, at in _ranges(keys, parts)], _MASSES)

    return run


def _word_totals(sent: pa.Table, masses: pa.Table) -> pa.Table:
    """To each block the totals of its words, how often an arc of theirs was followed, and the number of these arcs."""
    if not sent.num_rows:
        return _WORDS.empty_table()
    part = sent.column("part")[0].as_py()
    own, ends, distinct, totals, _, which = _received(sent)
    columns = [totals, np.zeros_like(totals), np.zeros_like(totals)]
    for k, f, a in zip(*(masses.column(c).to_pylist() for c in ("keys", "followed", "arcs"))):
        at = np.searchsorted(distinct, _unpacked_keys(k))
        columns[1][at] += _unpacked(f).astype(np.int64)
        columns[2][at] += _unpacked(a).astype(np.int64)
    lists = zip(*(np.split(c[which], ends) for c in columns))
    figures = [(int(totals.sum()), int((totals > 0).sum()))] + [(0, 0)] * (len(own) - 1)
    return _table([(b, part, *map(_packed, x), *f) for b, x, f in zip(own, lists, figures)], _WORDS)


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def _scored(total: int, distinct: int, schema: pa.Schema):
    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        is_pair = counts.column("is_pair")
        answers, pairs = counts.filter(pc.invert(is_pair)), _aligned(counts.filter(is_pair), "totals") >> 1
        words, pair_keys = _word_counts(docs)[0], _pair_counts(docs)[0]
        totals, followed, arcs = (_aligned(answers, c) for c in ("totals", "followed", "arcs"))
        failures = np.maximum(1 - (followed - DISCOUNT * arcs) / np.maximum(totals, 1), 1e-12)
        out = [[] for _ in range(4)]
        for _, tokens, starts in _tokens(docs.column("text")):
            count = _looked_up(words, totals, tokens).astype(np.float64)
            root = (count + 1) / (total + distinct + 1)
            before = _histories(tokens)
            arc = _looked_up(pair_keys, pairs, arc_key(before, tokens)).astype(np.float64)
            seen = _looked_up(words, totals, before).astype(np.float64)
            left = np.where(seen > 0, _looked_up(words, failures, before), 1.0)
            taken = np.where(arc >= MIN_ARC, (arc - DISCOUNT) / np.maximum(seen, 1), 0.0)
            chance = taken + left * root
            for column, values in zip(out, (np.ones(len(tokens)), count > 0, np.log10(root), np.log10(chance))):
                column.append(np.add.reduceat(values.astype(np.float64), starts[:-1]))
        n, known, base, score = (np.concatenate(c) for c in out)
        size = docs.num_rows
        return pa.Table.from_arrays(
            [docs.column("id"), docs.column("train"), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)),
             pa.array(np.full(size, total, np.int64)), pa.array(base), pa.array(score)],
            schema=schema,
        )

    return run


def score_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    trainable: Column | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Tokens are the words of the text (A-Z lowered, split at ASCII white space), then one end; a null
    or empty text is the end alone. The model learns from the rows for which ``trainable`` holds (all,
    if not given; null counts as no). ``base_score`` sums log10((c + 1) / (N + V + 1)) over tokens,
    ``score`` is the automaton's log10-probability of the text; with nothing to learn from both are 0.
    Repeated rows are learned and scored each; null ids are passed on; other columns are ignored; no
    rows give no rows. Words are equal when their 64-bit hashes are.

    Only the numbers of tokens and of words reach the driver. A word or pair is sent once per block
    however frequent it is, and hashes spread them evenly over as many ranges as there are blocks.
    """
    spark = docs.sparkSession
    train = F.coalesce(trainable, F.lit(False)) if trainable is not None else F.lit(True)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), train.alias("train"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // block_bytes))
    dealt = source.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(parts)).cast("int"))
    name = "blocks_" + new_scratch(spark, "x").rsplit("-", 1)[1]
    path = new_scratch(spark, "lm-blocks")
    dealt.repartition(parts, "block").write.bucketBy(parts, "block").option("path", path).option("compression", "zstd").saveAsTable(name)
    held = spark.table(name)

    sent = [held.groupBy("block").applyInArrow(_sent(counted, parts), _ddl(_SENT)) for counted in (_word_counts, _pair_counts)]
    pairs = stored(sent[1].groupBy("part").applyInArrow(_pair_totals, _ddl(_PAIRS)), "lm-pairs")
    masses = held.groupBy("block").cogroup(pairs.groupBy("block")).applyInArrow(_masses(parts), _ddl(_MASSES))
    words = sent[0].groupBy("part").cogroup(masses.groupBy("part")).applyInArrow(_word_totals, _ddl(_WORDS))
    words = stored(words, "lm-words")
    figures = words.agg(F.sum("tokens"), F.sum("words")).first()
    total, distinct = figures[0] or 0, figures[1] or 0

    back = words.select("block", "part", "totals", "followed", "arcs", F.lit(False).alias("is_pair"))
    back = back.unionByName(pairs.select("block", "part", "totals", F.lit(True).alias("is_pair")), allowMissingColumns=True)
    id_type = source.schema["id"].dataType
    schema = pa.schema(
        [("id", to_arrow_type(id_type)), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
         ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
    )
    ddl = f"id {id_type.simpleString()}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = held.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_scored(total, distinct, schema), ddl)
    return scored.select(F.col("id").alias(id_col), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
