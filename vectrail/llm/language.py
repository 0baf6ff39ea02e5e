"""Language identification by error-correcting output codes.

Every language gets a codeword of ``BITS`` bits; binary classifiers over hashed byte n-grams predict
the bits. A text goes to the language whose codeword loses least against the predicted margins, each
bit weighing by how well its classifier did; a small distance to the runner-up marks it ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks

BITS = 15
FEATURES = 1 << 12
ORDERS = (1, 2, 3)
ROWS_PER_LANGUAGE = 600  # labelled rows per language that train the classifiers
MAX_LANGUAGES = 1000
STEPS = 300
SHARPNESS = 4.0
AMBIGUOUS = 0.6  # score below which a text is flagged
UNKNOWN = "und"
_MULTIPLIERS = np.random.default_rng(11).integers(1, 1 << 31, 4, dtype=np.uint32) | np.uint32(1)


@dataclass(frozen=True)
class LanguageModel:
    """Codewords (+1/-1) by language, one linear classifier per bit, and the bits' weights."""

    languages: tuple[str, ...]
    codes: np.ndarray
    planes: np.ndarray
    bias: np.ndarray
    weights: np.ndarray


def codewords(n: int, bits: int = BITS, seed: int = 5) -> np.ndarray:
    """``n`` codewords far apart: the best of many random tables by smallest distance, no constant bit."""
    bits = max(bits, int(np.ceil(np.log2(max(n, 2)))) * 4)
    rng, best, score = np.random.default_rng(seed), None, -1
    for _ in range(200 if n <= 64 else 5):
        table = rng.choice((-1, 1), size=(n, bits))
        for b in np.flatnonzero(np.abs(table.sum(axis=0)) == n):
            table[rng.integers(n), b] *= -1
        if n == 1:
            return table
        distance = (bits - table @ table.T) // 2
        least = distance[~np.eye(n, dtype=bool)].min()
        if least > score:
            best, score = table, least
    return best


def ngram_counts(data: np.ndarray, out: np.ndarray) -> None:
    """Add a text's hashed byte n-grams (A-Z lowered) to ``out``."""
    low = blocks._LOWER[data].astype(np.uint32)
    h = np.zeros(len(low), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        if len(low) < order:
            break
        h = (h[: len(low) - order + 1] + low[order - 1 :] + np.uint32(order)) * _MULTIPLIERS[order]
        h ^= h >> np.uint32(15)
        if order in ORDERS:
            out += np.bincount(h & np.uint32(FEATURES - 1), minlength=FEATURES)


def features(data: np.ndarray) -> np.ndarray:
    """Square roots of the shares of the n-grams; the whole text counts, in pieces of a block."""
    out = np.zeros(FEATURES)
    for at in range(0, len(data), blocks.BLOCK_BYTES):
        ngram_counts(data[at : at + blocks.BLOCK_BYTES + max(ORDERS) - 1], out)
    return np.sqrt(out / max(out.sum(), 1))


def _features_of(batches):
    for batch in batches:
        data, offsets = blocks.buffers(batch.column("text"))
        rows = [features(data[a:b]).astype(np.float32).tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(rows, pa.binary())], names=["lang", "x"])


def _train(x: np.ndarray, targets: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One logistic classifier per column of ``targets`` (+1/-1), by accelerated gradient descent."""
    planes, bias = np.zeros((x.shape[1], targets.shape[1])), np.zeros(targets.shape[1])
    momentum, drift = np.zeros_like(planes), np.zeros_like(bias)
    weight = weight / weight.sum()
    for step in range(STEPS):
        ahead, level = planes + 0.9 * momentum, bias + 0.9 * drift
        margin = (x @ ahead + level) * targets
        pull = targets * (weight[:, None] / (1 + np.exp(np.clip(margin, -30, 30))))
        momentum = 0.9 * momentum + 4.0 * (x.T @ pull - 1e-5 * ahead)
        drift = 0.9 * drift + 0.5 * pull.sum(axis=0)
        planes, bias = planes + momentum, bias + drift
    return planes, bias


def fit_languages(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    key: Column | None = None,
    trainable: Column | None = None,
    rows_per_language: int = ROWS_PER_LANGUAGE,
) -> LanguageModel:
    """Learn from rows with a language and a text for which ``trainable`` holds.

    About ``rows_per_language`` whole texts per language, chosen by a hash of ``key`` (the text, if
    none is given), train the classifiers; that is the only bound. At most ``MAX_LANGUAGES``
    languages. Without any such row every text is ``und``.
    """
    known = docs.where(trainable) if trainable is not None else docs
    known = known.where(F.col(lang_col).isNotNull() & F.coalesce(F.col(text_col), F.lit("")).rlike(r"\p{L}"))
    known = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(key if key is not None else F.col(text_col), F.lit("language")).alias("place"))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return LanguageModel((), np.zeros((0, BITS)), np.zeros((FEATURES, BITS)), np.zeros(BITS), np.ones(BITS))
    languages = tuple(sorted(counts))
    share = F.create_map(*[F.lit(v) for k in languages for v in (k, rows_per_language / counts[k])])
    place = F.pmod("place", F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = known.where(place < share[F.col("lang")]).select("lang", "text")
    rows = sample.mapInArrow(_features_of, "lang string, x binary").collect()
    codes = codewords(len(languages))
    if not rows:
        return LanguageModel(languages, codes, np.zeros((FEATURES, codes.shape[1])), np.zeros(codes.shape[1]), np.ones(codes.shape[1]))
    rows.sort(key=lambda r: (r.lang, bytes(r.x)))
    x = np.stack([np.frombuffer(r.x, np.float32) for r in rows]).astype(np.float64)
    y = np.array([languages.index(r.lang) for r in rows])
    weight = 1 / np.bincount(y, minlength=len(languages))[y]
    planes, bias = _train(x, codes[y], weight)
    right = ((x @ planes + bias) * codes[y] > 0).mean(axis=0)
    weights = np.clip(2 * right - 1, 0.05, 1)
    return LanguageModel(languages, codes, planes, bias, weights / weights.sum())


def _decoded(model: LanguageModel, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, score, bits that disagree) for feature rows, by weighted logistic loss."""
    margins = x @ model.planes + model.bias
    loss = np.stack([(np.logaddexp(0, -margins * code) * model.weights).sum(axis=1) for code in model.codes], axis=1)
    odds = np.exp(-SHARPNESS * (loss - loss.min(axis=1, keepdims=True)))
    best = loss.argmin(axis=1)
    apart = (np.sign(margins) != model.codes[best]).sum(axis=1)
    return best, odds[np.arange(len(best)), best] / odds.sum(axis=1), apart


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col, lang_pred, score, ambiguous, bits_apart``.

    A text that is null, empty or without letters is ``und`` with score 0, not ambiguous. ``score`` is
    the language's share of the decoded odds; below ``AMBIGUOUS``, or with more bits wrong than
    the code corrects, the text is flagged. Ties go to the first language by name; repeated rows get
    the same answer; other columns are ignored. One pass, no shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    distance = min(
        (int((a != b).sum()) for i, a in enumerate(model.codes) for b in model.codes[:i]), default=model.codes.shape[1]
    )
    source = docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        F.coalesce(F.col(text_col), F.lit("")).rlike(r"\p{L}").alias("letters"),
    )
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = source.schema["id"].dataType
    schema = pa.schema([("id", to_arrow_type(id_type)), ("lang_pred", pa.string()), ("score", pa.float64()), ("bits_apart", pa.int32())])

    def run(batches):
        found = held.value
        for batch in batches:
            data, offsets = blocks.buffers(batch.column("text"))
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            n = batch.num_rows
            lang, score, apart = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n, np.int32)
            rows = np.flatnonzero(letters) if found.languages else np.zeros(0, int)
            for at in range(0, len(rows), 512):
                part = rows[at : at + 512]
                x = np.stack([features(data[offsets[i] : offsets[i + 1]]) for i in part])
                best, odds, wrong = _decoded(found, x)
                lang[part] = [found.languages[b] for b in best]
                score[part], apart[part] = odds, wrong
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lang, pa.string()), pa.array(score), pa.array(apart, pa.int32())], schema=schema)

    out = source.mapInArrow(run, f"id {id_type.simpleString()}, lang_pred string, score double, bits_apart int")
    doubtful = (F.col("lang_pred") != UNKNOWN) & ((F.col("score") < AMBIGUOUS) | (F.col("bits_apart") > (distance - 1) // 2))
    return out.select(F.col("id").alias(id_col), "lang_pred", "score", doubtful.alias("ambiguous"), "bits_apart")
