"""Embedding whitening: principal components of all vectors by a randomised range finder, scaled to unit variance.

A random basis of a few more directions than components are asked for is multiplied by the covariance of the centred
rows and made orthonormal again, some times over; every product is one pass over all rows, of which each task returns a
matrix as large as the basis. Rayleigh-Ritz in that basis gives eigenvalues and components. Where a component's
residual isn't as small as rounding allows, as with spectra that hardly fall, the basis is expanded to the full
dimension, in which the same step is exact. What the driver holds is of the size of the covariance at most.

Sums and deviations are exact integers; only centred numbers are multiplied.

Defined results: vectors that are null or hold null or non-finite components take no part, those of different lengths
are padded by zeros; null and repeated ids are rows like others; a component without variance (fewer rows than
dimensions, equal vectors) has a null ``whitened`` and 0 for ``explained``, and doesn't count in ``identity_error``; a
deviation beyond 64 bits is null; components of 2^17 or more raise; an empty table or empty vectors give no rows; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BATCH, map_arrow
from .vectors import extent, integers, kept, summed

SCALE, SHIFT = 1024, 100_000
OVERSAMPLE, PASSES, SEED = 8, 3, 20_240
RESIDUAL = 1e-13  # of the largest eigenvalue
NOTHING = 1e-13  # of the trace: an eigenvalue below is rounding


def _sums(width: int):
    def run(batches):
        total = np.zeros(width, np.int64)
        for b in batches:
            total += integers(b.column("v"), width, SCALE).sum(axis=0)
        return total

    return run


def _product(mean: np.ndarray, basis: np.ndarray):
    """Sum over the rows of centred row times its coordinates in the basis, and of squared norms."""

    def run(batches):
        total, squares = np.zeros(basis.shape), 0.0
        for b in batches:
            x = integers(b.column("v"), len(mean), SCALE) - mean
            total += x.T @ (x @ basis)
            squares += (x**2).sum()
        return np.append(total.ravel(), squares)

    return run


def _moments(mean: np.ndarray, to: np.ndarray):
    """Sums of whitened rows and of their products."""

    def run(batches):
        k = to.shape[1]
        total = np.zeros((k + 1, k))
        for b in batches:
            w = (integers(b.column("v"), len(mean), SCALE) - mean) @ to
            total[0] += w.sum(axis=0)
            total[1:] += w.T @ w
        return total.ravel()

    return run


def ritz(basis: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues (falling), components and residuals of a symmetric matrix in an orthonormal basis, from its product with the basis."""
    inner = basis.T @ product
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    components = basis @ turn
    residuals = np.linalg.norm(product @ turn - components * values, axis=0)
    components = components / np.linalg.norm(components, axis=0)
    return values, components * np.sign(components[np.abs(components).argmax(axis=0), np.arange(len(values))]), residuals


def principal(vecs: DataFrame, n: int, mean: np.ndarray, k: int, oversample: int = OVERSAMPLE, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, float]:
    """The k largest eigenvalues of the covariance of v, their components as columns, and the trace."""
    width = len(mean)
    random = np.random.default_rng(SEED)

    def times(basis):
        out = summed(vecs, _product(mean, basis), basis.size + 1, "double") / n
        return out[:-1].reshape(basis.shape), float(out[-1])

    basis = np.linalg.qr(random.standard_normal((width, min(width, k + oversample))))[0]
    for _ in range(passes if basis.shape[1] < width else 0):
        basis = np.linalg.qr(times(basis)[0])[0]
    product, trace = times(basis)
    values, components, residuals = ritz(basis, product)
    if basis.shape[1] < width and (residuals[:k] > RESIDUAL * values[0]).any():
        more = random.standard_normal((width, width - basis.shape[1]))
        basis = np.linalg.qr(np.concatenate([basis, more], axis=1))[0]
        product, trace = times(basis)
        values, components, residuals = ritz(basis, product)
    return values[:k], components[:, :k], trace


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    most = n * float(np.abs(x).max(initial=0)) + float(np.abs(sums).max(initial=0))
    if len(sums) * most**2 < 2**62:
        return ((n * x - sums) ** 2).sum(axis=1).tolist()
    exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums.tolist(), strict=True)) for row in x.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


def _whitened(n: int, sums: np.ndarray, to: np.ndarray, explained: list[float], error: float):
    k, mean = to.shape[1], sums / n

    def run(batches):
        for b in (whole.slice(i, BATCH) for whole in batches for i in range(0, len(whole), BATCH)):
            x = integers(b.column("v"), len(sums), SCALE)
            w = (x - mean) @ to
            row = np.repeat(np.arange(len(b)), k)
            cols = [
                b.column("vec_id").take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(b))), pa.array(np.full(len(row), n)),
                pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(row)), pa.array(w.ravel(), mask=np.isnan(w).ravel()), pa.array(np.tile(explained, len(b))), pa.array(np.full(len(row), error)),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(df: DataFrame, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", oversample: int = OVERSAMPLE, passes: int = PASSES) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and each of its first k components."""
    spark = df.sparkSession
    vecs = kept(df, vector_col, vec_id=id_col)
    kind = vecs.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    only = vecs.select("v")
    n, width = extent(only)
    if not n or not width:
        return spark.createDataFrame([], schema)
    # the shift of all components cancels out wherever they are centred
    sums = summed(only, _sums(width), width, "long")
    mean = sums / n
    values, components, trace = principal(only, n, mean, min(k, width), oversample, passes)
    there = values > NOTHING * trace
    to = np.where(there, components / np.sqrt(np.where(there, values, 1)), np.nan)
    held = to[:, there]
    error = 0.0
    if there.any():
        m = summed(only, _moments(mean, held), (held.shape[1] + 1) * held.shape[1], "double").reshape(-1, held.shape[1]) / n
        error = float(np.abs(m[1:] - np.outer(m[0], m[0]) - np.eye(held.shape[1])).max())
    explained = np.where(there, values / (trace or 1), 0.0).tolist()
    return map_arrow(vecs, _whitened(n, sums, to, explained, error), schema)
