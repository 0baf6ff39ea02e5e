"""Whitening against a dense eigendecomposition."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrail.llm import whitening

ROWS = "vec_id long, embedding array<float>, id string, x string, component string"  # the last three clash with names used inside


def dense(vectors):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], np.int64)
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    return x, n, sums, centred, values[::-1], basis[:, ::-1]


def vectors(n=300, d=20, seed=1):
    rng = np.random.default_rng(seed)
    mix = rng.standard_normal((d, d)) * np.linspace(3, 0.1, d)
    return (rng.standard_normal((n, d)) @ mix).astype(np.float32).tolist()


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], ROWS)


def test_whitening_equals_eigenvectors(spark):
    v = vectors()
    odd = [(900, None), (901, []), (902, [None] * 20), (903, [math.nan] * 20), (904, [math.inf] * 20), (905, [1.0] * 19), (906, [3e30] * 20)]
    rows = list(enumerate(v)) + odd
    got = whitening.whiten(frame(spark, rows).repartition(4), components=8).collect()
    x, n, sums, centred, values, basis = dense(v)
    assert len(got) == n * 8
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    by = {(r.vec_id, r.component): r for r in got}
    for k in range(8):
        want = centred @ basis[:, k] / np.sqrt(values[k])
        mine = np.array([by[i, k + 1].whitened for i in range(n)])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-9
    for r in got:
        assert r.n == n and int(r.deviation) == deviation[r.vec_id]
        assert abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-10
        assert r.identity_error < 1e-10


def test_stops_early_when_values_are_settled(spark):
    rng = np.random.default_rng(2)
    v = (rng.standard_normal((400, 3)) @ rng.standard_normal((3, 60)) * 5 + rng.standard_normal((400, 60)) * 0.1).tolist()
    rows = frame(spark, list(enumerate(v))).select(whitening.on_grid(F.col("embedding")).alias("x"))
    model = whitening.fit_whitening(rows, 2)
    *_, values, _ = dense(v)
    assert model.steps < 60
    assert np.allclose(model.variances, values[:2], rtol=1e-12)


def test_repeated_variances_and_flat_dimensions(spark):
    v = [[float(s) if i == k else 0.0 for i in range(6)] + [1.0, 2.0] for k in range(4) for s in (1, -1)]
    got = whitening.whiten(frame(spark, list(enumerate(v))))
    rows = got.collect()
    assert {r.component for r in rows} == {1, 2, 3, 4}  # the rest does not vary
    assert all(abs(r.explained - 0.25) < 1e-12 and r.identity_error < 1e-12 for r in rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 0.5])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])]])
def test_nothing_to_whiten(spark, rows):
    got = whitening.whiten(frame(spark, rows))
    assert got.count() == 0
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_entries_null_ids_and_repeated_rows(spark):
    rng = random.Random(4)
    v = [[rng.uniform(-1, 1) * 2.0**40 for _ in range(3)] for _ in range(20)]
    v = [np.float32(x).tolist() for x in v]
    rows = list(enumerate(v)) + [(None, v[0]), (3, v[3])]
    got = whitening.whiten(frame(spark, rows), components=3).collect()
    assert len(got) == 22 * 3
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in w] for _, w in rows]
    sums = [sum(c) for c in zip(*x)]
    want = sorted(sum((22 * a - s) ** 2 for a, s in zip(r, sums)) for r in x)
    assert sorted(int(r.deviation) for r in got if r.component == 1) == want
