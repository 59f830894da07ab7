"""Whitened vectors against a direct eigendecomposition."""

import math

import numpy as np
import pytest

from tessel.llm import whitening

COLUMNS = "vec_id long, embedding array<float>, label int"


def direct(vectors, k):
    width = max(len(v) for v in vectors)
    x = np.array([[math.floor(1024 * c) + 100_000 for c in [*v, *[0.0] * (width - len(v))]] for v in vectors])
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return ((n * x - s) ** 2).sum(axis=1), c @ u / np.sqrt(e), e / (c**2).sum() * n


def check(out, ids, vectors, k=8):
    deviation, w, explained = direct(vectors, k)
    k = w.shape[1]
    got = sorted(map(tuple, out.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error").collect()))
    assert [r[:3] for r in got] == [(i, c, len(ids)) for i in sorted(ids) for c in range(1, k + 1)]
    order = np.argsort(ids)
    assert [r[3] for r in got[::k]] == deviation[order].tolist()
    found = np.array([r[4] for r in got]).reshape(-1, k)
    sign = np.sign((found * w[order]).sum(axis=0))
    assert np.abs(found * sign - w[order]).max() < 1e-7
    assert np.abs(np.array([r[5] for r in got[:k]]) - explained).max() < 1e-12
    assert len({r[6] for r in got}) == 1 and got[0][6] < 1e-9


@pytest.mark.parametrize("fall", [0.02, 0.7])
def test_flat_and_falling_spectra(spark, fall):
    """The first is expanded to the full dimension, the second is settled by the range finder."""
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(400, 24)) * 40 * np.exp(-fall * np.arange(24)) + 3).astype(np.float32).astype(float).tolist()
    data = [(i, x, 0) for i, x in enumerate(v)] + [(900, None, 1), (901, [1.0, None], 1), (902, [float("nan")] * 24, 1), (903, [float("-inf")], 1)]
    df = spark.createDataFrame(data, COLUMNS).selectExpr("*", "1 AS n", "'x' AS v", "'x' AS whitened").repartition(3)
    check(whitening.whiten(df, passes=12), list(range(400)), v)


def test_range_finder_settles_without_expansion(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 40)) * 100 * np.exp(-np.arange(40.0))
    seen = []
    real = whitening.ritz
    monkeypatch.setattr(whitening, "ritz", lambda basis, product: seen.append(basis.shape[1]) or real(basis, product))
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], COLUMNS)
    whitening.whiten(df, k=3)
    assert seen == [11]
    seen.clear()
    flat = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(rng.normal(size=(300, 40)))], COLUMNS)
    whitening.whiten(flat, k=3)
    assert seen == [11, 40]


def test_lengths_ids_and_repeated_rows(spark):
    v = [[0.5, 1.0, -2.0], [1.0], [0.25, 3.0], [0.5, 1.0, -2.0], [7.0, 0.0, 1.0], [-1.0, 2.0, 2.0]]
    df = spark.createDataFrame([(i, x, 0) for i, x in enumerate(v)], COLUMNS)
    check(whitening.whiten(df), list(range(6)), v)
    out = whitening.whiten(spark.createDataFrame([(None, x, 0) for x in v] + [(1, v[0], 0)] * 2, COLUMNS)).collect()
    assert len(out) == 8 * 3 and sum(r["vec_id"] is None for r in out) == 6 * 3


def test_no_variance(spark):
    out = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(3)], COLUMNS)).collect()
    assert {(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in out} == {(None, 0.0, 0.0, 0)}
    out = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0], 0) for i in range(3)], COLUMNS)).collect()
    assert {(r["component"], r["whitened"] is None, round(r["explained"], 12)) for r in out} == {(1, False, 1.0), (2, True, 0.0)}
    assert whitening.whiten(spark.createDataFrame([(1, None, 0), (2, [], 0)], COLUMNS)).collect() == []


def test_deviation_beyond_a_long_is_null():
    x = np.array([[1 << 26, 0], [0, 0]])
    assert whitening._deviations(x, 2, x.sum(axis=0)) == [1 << 52, 1 << 52]
    n = 1 << 20
    assert whitening._deviations(x, n, np.array([0, 0])) == [None, 0]
