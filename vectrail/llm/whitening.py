"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

With X the centred rows, X V = U B and its transpose X'U = V B' + rest hold for an upper bidiagonal B.
Each step multiplies every block of rows by a vector (X c = u) and, in the same pass, the blocks by what
came out (X'u). A left vector u is as long as the table; it lies in the span of X, so only its
coefficients c are kept, and its products with earlier left vectors follow from their X'u. Both sides
are orthogonalised in full. The singular values of the small B are the deviations, its right vectors
give the components.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored

COMPONENTS = 32
GRID, SHIFT = 64.0, 1_000_000
EXACT = float(1 << 53)  # grid values from here on are no longer told apart by a double
TOLERANCE = 1e-14  # of the largest singular value: what is left of a vector below it is rounding


@dataclass(frozen=True)
class Whitening:
    """Sums over the fit list, components (one a row) and their variances; its size is that of the dimensions squared."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    steps: int


def on_grid(vector: Column) -> Column:
    """floor(64 c) + 1000000 of every entry; null where the vector is null or holds null, non-finite or unrepresentable entries."""
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * GRID) + SHIFT)
    fine = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) * GRID < EXACT, F.lit(False)))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & fine, x)


def _whole(numbers) -> np.ndarray:
    return np.array(numbers, np.int64 if max(map(abs, numbers)) < 1 << 62 else object)


def _matrix(batch, name: str = "x") -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """(n x - S) / n: the difference is taken in whole numbers."""
    return _differences(x, n, sums).astype(np.float64) / n


def _differences(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    if sums.dtype != object and n * int(np.abs(x).max(initial=0)) < 1 << 62:
        return n * x - sums
    return n * x.astype(object) - sums.astype(object)


def _total(rows: DataFrame, names: list[str]) -> dict[int, tuple]:
    """Sums of small numbered rows of all tasks."""
    return {r[0]: tuple(r)[1:] for r in rows.groupBy("at").agg(*[F.sum(c).alias(c) for c in names]).collect()}


def _products(n: int, sums: np.ndarray, c: np.ndarray):
    def run(batches):
        length, back = 0.0, np.zeros(len(c))
        for batch in batches:
            if batch.num_rows:
                x = _centred(_matrix(batch), n, sums)
                u = x @ c
                length += u @ u
                back += x.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(c)), pa.int32()), pa.array([length, *back])], names=["at", "v"])

    return run


def bidiagonalise(rows: DataFrame, n: int, sums: np.ndarray, wanted: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    """(components, singular values, steps) of the centred ``x`` of ``rows``.

    Stops once the wanted values are settled, or all dimensions are used up.
    """
    d, rng = len(sums), np.random.default_rng(seed)
    right, left, images = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))
    alphas, betas = [], []

    def without(v, basis, weights):
        for _ in range(2):  # once is not enough where most of a vector cancels
            v = v - basis @ (weights.T @ v)
        return v

    def fresh():
        v = without(rng.standard_normal(d), right, right)
        return v / np.linalg.norm(v)

    v, beta, last, scale = fresh(), 0.0, np.zeros(d), 0.0
    while True:
        right = np.column_stack((right, v))
        c = without(v - beta * last, left, images)
        found = _total(rows.mapInArrow(_products(n, sums, c), "at int, v double"), ["v"])
        alpha, back = float(np.sqrt(found[-1][0])), np.array([found[k][0] for k in range(d)])
        scale = max(scale, alpha)
        if alpha > TOLERANCE * scale and alpha > 0:
            last = c / alpha
            left, images = np.column_stack((left, last)), np.column_stack((images, back / alpha))
            rest = without(back / alpha - alpha * v, right, right)
        else:  # the rows have no part along v beyond those seen: its left vector is arbitrary
            alpha, last, rest = 0.0, np.zeros(d), np.zeros(d)
        alphas.append(alpha)
        beta = float(np.linalg.norm(rest))
        steps = len(alphas)
        small = np.diag(alphas) + np.diag(betas, 1)
        p, values, q = np.linalg.svd(small)
        top = min(wanted, steps)
        settled = steps >= wanted and beta > 0 and np.all(beta * np.abs(p[-1, :top]) <= 1e-15 * values[0])
        if steps == d or settled:
            return (right @ q.T)[:, :top].T, values[:top], steps
        if beta > TOLERANCE * max(scale, 1e-300):
            v = rest / beta
        else:  # a subspace is used up; go on outside it
            v, beta = fresh(), 0.0
        betas.append(beta)


def _sums(batches):
    n, total = 0, None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch)
            n += len(x)
            wide = len(x) * int(np.abs(x).max()) >= 1 << 62
            part = (x.astype(object) if wide else x).sum(axis=0).tolist()
            total = part if total is None else [a + b for a, b in zip(total, part)]
    if n:
        values = pa.array([n, *total], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), values], names=["at", "v"])


def fit_whitening(rows: DataFrame, wanted: int = COMPONENTS) -> Whitening | None:
    """Fit on all rows' ``x`` (arrays of one length); None without rows. Components without any deviation are left out."""
    found = _total(rows.mapInArrow(_sums, "at int, v decimal(38,0)"), ["v"])
    if not found:
        return None
    n, sums = int(found[-1][0]), _whole([int(found[k][0]) for k in range(len(found) - 1)])
    d = len(sums)
    components, values, steps = bidiagonalise(rows, n, sums, min(wanted, d))
    real = values > 1e-12 * max(values[0], 1e-300) if len(values) else []
    squares = _total(rows.mapInArrow(_squares(n, sums), "at int, v double"), ["v"])[0][0]
    return Whitening(n, tuple(map(int, sums)), components[real], values[real] ** 2 / n, squares / n, steps)


def _squares(n: int, sums: np.ndarray):
    def run(batches):
        total = sum((float((_centred(_matrix(b), n, sums) ** 2).sum()) for b in batches if b.num_rows), 0.0)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total])], names=["at", "v"])

    return run


def _whitened(x: np.ndarray, model: Whitening) -> np.ndarray:
    return _centred(x, model.n, _whole(model.sums)) @ model.components.T / np.sqrt(model.variances)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest entry, sign aside, of the whitened rows' covariance (centred, over n) minus the identity."""
    k = len(model.variances)

    def means(batches):
        total = np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                total += _whitened(_matrix(batch), model).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(total)], names=["at", "v"])

    found = _total(rows.mapInArrow(means, "at int, v double"), ["v"])
    mean = np.array([found[i][0] for i in range(k)]) / model.n

    def products(batches):
        total = np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = _whitened(_matrix(batch), model) - mean
                total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), pa.array(total.ravel())], names=["at", "v"])

    found = _total(rows.mapInArrow(products, "at int, v double"), ["v"])
    covariance = np.array([found[i][0] for i in range(k * k)]).reshape(k, k) / model.n
    return float(np.abs(covariance - np.eye(k)).max())


def _projected(model: Whitening, error: float, id_type: pa.DataType):
    sums, k = _whole(model.sums), len(model.variances)
    share = model.variances / model.trace

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                x = _matrix(part)
                diff = _differences(x, model.n, sums)
                most = int(np.abs(diff).max(initial=0))
                if diff.dtype != object and len(sums) * most * most >= 1 << 62:
                    diff = diff.astype(object)
                deviation = pa.array([int(v) for v in (diff**2).sum(axis=1)], pa.decimal128(38, 0))
                white = _whitened(x, model)
                row = np.repeat(np.arange(len(x)), k)
                arrays = [
                    part.column("id").cast(id_type).take(pa.array(row)),
                    pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                    pa.array(np.full(len(row), model.n), pa.int64()),
                    deviation.take(pa.array(row)),
                    pa.array(white.ravel()),
                    pa.array(np.tile(share, len(x))),
                    pa.array(np.full(len(row), error)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", *_OUT])

    return run


_OUT = ["component", "n", "deviation", "whitened", "explained", "identity_error"]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Every usable vector on every component, one row each.

    ``id_col, component`` (from 1, by falling variance), ``n`` (vectors fitted on: all usable ones),
    ``deviation`` (sum of (n x - S)^2, exact, 38 digits), ``whitened``, ``explained``, ``identity_error``.
    A vector is put on the grid floor(64 c) + 1000000 first. Left out are vectors that are null or
    empty, hold null or non-finite entries or entries of 2^47 or more, and those of another length than most
    (the longer of equally frequent lengths counts). Repeated rows and null ids count as vectors. A
    component along which nothing varies cannot be whitened and has no rows; nor has anything if all
    vectors are equal, or there are none. Variances that tie have components in any order that spans
    their space. Other columns are ignored, whatever their names.

    Every step is a pass over the stored grid values that moves one number per dimension and task.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = vectors.sparkSession
    source = vectors.select(F.col(id_col).alias("id"), on_grid(F.col(vector_col)).alias("x")).where("x is not null")
    kind = source.schema["id"].dataType
    rows = stored(source, "grid")
    sizes = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    ddl = f"id {kind.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = rows.where(F.size("x") == (sizes[0].size if sizes else 0))
    model = fit_whitening(rows, components)
    if model is None or not len(model.variances):
        return spark.createDataFrame([], ddl).withColumnRenamed("id", id_col)
    error = identity_error(rows, model)
    return rows.mapInArrow(_projected(model, error, to_arrow_type(kind)), ddl).withColumnRenamed("id", id_col)
