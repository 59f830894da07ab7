"""Vectors as integer matrices, and sums over all rows that are as many as the model has numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, map_arrow, small_batches

#: Components whose integers have this magnitude or more can't be calculated with; a vector that holds one raises.
LIMIT = 1 << 27


def sound(v: Column) -> Column:
    """The vector and all its components are there and finite."""
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def kept(df: DataFrame, vector_col: str, **columns: str) -> DataFrame:
    """The columns by their new names and v (array<double>) of the rows whose vectors are sound."""
    v = column(df, vector_col)
    return df.where(sound(v)).select(*[column(df, c).alias(name) for name, c in columns.items()], v.cast("array<double>").alias("v"))


def integers(v: pa.ListArray, width: int, scale: int) -> np.ndarray:
    """floor(scale * component) of each row, padded by zeros to the width."""
    flat, at = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()
    x = np.floor(scale * flat[at[0] : at[-1]])
    if (np.abs(x) >= LIMIT).any():
        raise ValueError(f"a component is beyond {LIMIT // scale}")
    return padded(x.astype(np.int64), np.diff(at), width)


def padded(flat: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Rows of those sizes, one after the other in flat, padded by zeros."""
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def extent(vecs: DataFrame) -> tuple[int, int]:
    """Number of vectors and length of the longest."""
    n, width = vecs.agg(F.count("*"), F.max(F.size("v"))).first()
    return n, width or 0


def summed(rows: DataFrame, f, size: int, kind: str) -> np.ndarray:
    """The sums over all tasks of arrays of that size: f yields a task's array; they meet by place, so only the sums reach the driver."""

    def run(batches):
        total = f(batches)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 65_536]), pa.array(total[at[i : i + 65_536]])], ["at", "v"])

    with small_batches(rows.sparkSession):
        every = map_arrow(rows, run, f"at long, v {kind}").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size, np.int64 if kind == "long" else np.float64)
    out[every["at"].to_numpy()] = every["v"].to_numpy()
    return out
