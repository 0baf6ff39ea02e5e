"""Compression classifier: zstandard dictionaries of good and of bad text, and what they save.

A text is compressed in blocks with either dictionary. The difference of the two sizes over the
text's length says which kind of text it resembles; a logistic curve fitted on labelled texts that
went into neither dictionary turns it into a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .registry import free
from .scratch import stored

DICT_ROWS = 1_500  # labelled rows per class whose blocks build a dictionary
FIT_ROWS = 4_000  # labelled rows per class that fit the curve
DICT_BYTES = 112_640
BLOCK = 512
LEVEL = 3
HALF = 200.0  # bytes at which a text's difference counts half
THRESHOLD = 0.3


@dataclass(frozen=True)
class QualityModel:
    """Two dictionaries and the curve; a few hundred kilobytes whatever the corpus."""

    good: bytes
    bad: bytes
    curve: tuple[float, ...]

    def compressors(self):
        out = []
        for content in (self.good, self.bad):
            held = zstandard.ZstdCompressionDict(content)
            held.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False))
        return out


def _features(text: bytes, good, bad) -> tuple[float, float, float]:
    saved = 0
    for at in range(0, len(text), BLOCK):
        block = text[at : at + BLOCK]
        saved += len(bad.compress(block)) - len(good.compress(block))
    weight = len(text) / (len(text) + HALF)
    return saved / max(len(text), 1) * weight, weight, saved / max(len(text), 1) * (1 - weight)


def _probability(features, curve) -> float:
    z = curve[0] + sum(a * b for a, b in zip(curve[1:], features))
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _sampled_blocks(batches):
    """All blocks of each text."""
    for batch in batches:
        labels, found = [], []
        for text, label in zip(batch.column("text"), batch.column("label").to_pylist()):
            raw = (text.as_py() or "").encode()
            for at in range(0, len(raw), BLOCK):
                labels.append(label), found.append(raw[at : at + BLOCK])
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(found, pa.binary())], names=["label", "block"])


def _dictionary(samples: list[bytes]) -> bytes:
    samples = sorted(samples)
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to choose from: their end is the dictionary
        return b"".join(samples)[-DICT_BYTES:] or b"\n" * 8


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton's method with a slight ridge."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    a = np.column_stack((np.ones(len(x)), x / scale))
    beta = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        gradient = a.T @ (weight * (y - p)) - 1e-2 * beta
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(beta))
        beta = beta + np.linalg.solve(hessian, gradient)
    return (float(beta[0]), *map(float, beta[1:] / scale))


def _constant(labels) -> QualityModel:
    """For labels of one class or none: their share of good ones for every text."""
    share = (1 if 1 in labels else 0) if labels else 0.5
    return QualityModel(b"\n" * 8, b"\n" * 8, (float(np.log((share + 0.01) / (1.01 - share))), 0.0, 0.0, 0.0))


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    trainable: Column | None = None,
) -> QualityModel:
    """Fit on the labelled rows for which ``trainable`` (over ``id_col``) holds.

    The sample is bounded: about ``DICT_ROWS`` and ``FIT_ROWS`` rows per class, chosen by a hash of
    the id, whatever the number of labels; whole texts. Labels other than 0 and 1 and rows without an
    id are ignored. Without labelled texts of both classes (an empty ``docs`` has none), every text
    gets the share of good labels (0.5 without any).
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.where("id is not null and label in (0, 1)")
    if trainable is not None:
        known = known.where(trainable)
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return _constant(counts)
    place = F.pmod(F.xxhash64(F.col("id"), F.lit("quality")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, (DICT_ROWS + FIT_ROWS) / n)])
    picked = known.withColumn("place", place / share[F.col("label")]).where("place < 1")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = stored(texts.join(F.broadcast(picked), "id"), "quality-sample")
    first = DICT_ROWS / (DICT_ROWS + FIT_ROWS)
    parts = {0: [], 1: []}
    for row in sample.where(F.col("place") < first).select("text", "label").mapInArrow(_sampled_blocks, "label int, block binary").collect():
        parts[row.label].append(bytes(row.block))
    model = QualityModel(_dictionary(parts[1]), _dictionary(parts[0]), (0.0,) * 4)
    rows = _measured(sample.where(F.col("place") >= first).select("label", "text"), "text", model, curve=False).collect()
    if len({r.label for r in rows}) < 2:
        rows = _measured(sample.select("label", "text"), "text", model, curve=False).collect()
    if len({r.label for r in rows}) < 2:
        return _constant({r.label for r in rows})
    x, y = np.array([r.measure for r in rows]), np.array([r.label for r in rows])
    weight = np.array([counts[k] / max((y == k).sum(), 1) for k in (0, 1)])[y]
    return QualityModel(model.good, model.bad, _fit(x, y, weight / weight.mean()))


def _measured(df: DataFrame, text_col: str, model: QualityModel, curve: bool = True, name: str = "measure") -> DataFrame:
    """``df`` with the text's measure: its score, or the features behind it."""
    held = df.sparkSession.sparkContext.broadcast(model)
    others = [c for c in df.columns if c != text_col or curve]
    schema = StructType(
        [df.schema[c] for c in others]
        + [StructField(name, df.sparkSession.range(0).select(F.lit(0.0) if curve else F.array(F.lit(0.0))).schema[0].dataType)]
    )

    def run(batches):
        good, bad = held.value.compressors()
        for batch in batches:
            values = []
            for text in batch.column(text_col):
                features = _features((text.as_py() or "").encode(), good, bad)
                values.append(_probability(features, held.value.curve) if curve else list(features))
            arrays = [batch.column(c) for c in others] + [pa.array(values, pa.float64() if curve else pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*others, name])

    return df.select(*others, *([] if text_col in others else [text_col])).mapInArrow(run, schema)


def score_quality(
    docs: DataFrame,
    model: QualityModel,
    text_col: str = "text",
    threshold: float = THRESHOLD,
    score_col: str = "score",
    predicted_col: str = "predicted",
) -> DataFrame:
    """``docs`` with ``score_col`` (0 to 1) and ``predicted_col`` (1 from ``threshold`` on), replacing columns so named.

    Null and empty texts save nothing with either dictionary; their score is the curve's at no
    length. Ties and repeated rows get the same score. All other columns are passed on, whatever
    their names. One pass, no shuffle.
    """
    kept = [c for c in docs.columns if c not in (score_col, predicted_col)]
    name = free(kept, "measure")
    scored = _measured(docs.select(*kept), text_col, model, name=name)
    return scored.select(*kept, F.col(name).alias(score_col), (F.col(name) >= threshold).cast("int").alias(predicted_col))
