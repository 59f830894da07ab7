"""Vector code compression: product codes from Lloyd's iterations with Elkan's bounds.

Each part of the vectors has a codebook. Between rounds every row keeps, for each part, an upper bound of the distance to
its entry and one lower bound for each entry of the codebook; a round shifts them by how far the entries moved. An entry
is left out only where the triangle inequality proves it farther, strictly and beyond what rounding can do: because its
lower bound exceeds the upper one, or because half its distance from the row's entry does. All others are compared by
exact integer squared distances, so ties go to the lower index.

The rows with their bounds are written each round, block after block, so that little more than one copy is there; lower
bounds take half a byte (steps between a part's least and greatest distance, rounded down). Sums of parts come from each
task as arrays of the codebooks' size, which is all that reaches the driver.

Defined results: vectors that are null or hold null or non-finite components take no part; those of different lengths are
padded by zeros, to a multiple of the parts; rows with a null or repeated id are rows like others (the first entries come
from the least non-null ids, repeated ones by vector; only without any from null ones); fewer rows than entries give a
smaller codebook; components of 2^17 or more raise; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, map_arrow, table
from .texts import small
from .vectors import extent, integers, kept, padded, summed

SCALE = 1024
BLOCKS = 2
UP, DOWN = 1 + 1e-9, 1 - 1e-9  # beyond all rounding of what they multiply
LEVELS = 15
MANY = 32  # entries that a row may need before all are compared by one product
PAIRS = 65_536  # compared at once


def dense(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of all rows and entries, exact."""
    top = max(float(np.abs(x).max(initial=0)), float(np.abs(book).max(initial=0)), 1.0)
    if 4 * top**2 * max(1, x.shape[1]) < 2**53:  # exact in doubles
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a**2).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b**2).sum(axis=1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in book], axis=1)


def distances(x: np.ndarray, book: np.ndarray, row: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Squared distances of (row, entry) pairs, exact."""
    parts = [((x[row[i : i + PAIRS]] - book[entry[i : i + PAIRS]]) ** 2).sum(axis=1) for i in range(0, len(row), PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


class Movement:
    """What a round needs of one part's codebook: its entries, how far each moved, and half the distances between them, rounded down."""

    def __init__(self, book: np.ndarray, before: np.ndarray):
        self.book = book
        self.moved = np.sqrt(((book - before) ** 2).sum(axis=1)) * UP
        self.half = np.sqrt(dense(book, book)) / 2 * DOWN
        apart = self.half + np.where(np.eye(len(book), dtype=bool), np.inf, 0)
        self.alone = apart.min(axis=1)


def first(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code, upper bound and lower bounds of rows without bounds."""
    d = dense(x, book)
    code = d.argmin(axis=1)
    far = np.sqrt(d)
    return code, far[np.arange(len(x)), code] * UP, far * DOWN


def again(x: np.ndarray, m: Movement, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after the entries moved, and how many distances were calculated."""
    upper = (upper + m.moved[code]) * UP
    lower = np.maximum(lower - m.moved, 0) * DOWN
    open_ = np.flatnonzero(upper >= m.alone[code])
    if not len(open_):
        return code, upper, lower, 0
    y, own, low = x[open_], code[open_], lower[open_]
    d = ((y - m.book[own]) ** 2).sum(axis=1)
    up = np.sqrt(d) * UP
    at = np.arange(len(open_))
    low[at, own] = np.sqrt(d) * DOWN
    may = (low <= up[:, None]) & (m.half[own] <= up[:, None])
    may[at, own] = False
    needed = may.sum(axis=1)
    best_d, best = d.copy(), own.copy()
    wide = np.flatnonzero(needed >= MANY)
    if len(wide):
        all_ = dense(y[wide], m.book)
        best[wide] = all_.argmin(axis=1)
        best_d[wide] = all_[np.arange(len(wide)), best[wide]]
        low[wide] = np.sqrt(all_) * DOWN
        may[wide] = False
    row, entry = np.nonzero(may)
    if len(row):
        pair = distances(y, m.book, row, entry)
        low[row, entry] = np.sqrt(pair) * DOWN
        # the nearest of each row's pairs, ties to the lower index, against its own entry by the same rule
        order = np.lexsort((entry, pair, row))
        lead = order[np.concatenate([[True], np.diff(row[order]) > 0])]
        r, e, p = row[lead], entry[lead], pair[lead]
        nearer = (p < best_d[r]) | (p == best_d[r]) & (e < best[r])
        best[r[nearer]], best_d[r[nearer]] = e[nearer], p[nearer]
    code, upper = code.copy(), upper.copy()
    code[open_], upper[open_], lower[open_] = best, np.sqrt(best_d) * UP, low
    return code, upper, lower, len(open_) + len(wide) * len(m.book) + len(row)


def pack(lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower bounds as (least, step, half a byte each), rounded down."""
    least = lower.min(axis=1)
    step = np.maximum((lower.max(axis=1) - least) / LEVELS, 1e-300)
    q = np.floor((lower - least[:, None]) / step[:, None] * DOWN).astype(np.uint8)
    q = np.pad(q, ((0, 0), (0, q.shape[1] % 2)))
    return least, step, q[:, ::2] | q[:, 1::2] << 4


def unpack(least: np.ndarray, step: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
    out = np.empty((len(q), 2 * q.shape[1]), np.uint8)
    out[:, ::2], out[:, 1::2] = q & 15, q >> 4
    return (least[:, None] + out[:, :n] * step[:, None]) * DOWN


STATE = "x array<long>, code array<int>, bounds array<double>, lower binary"


def _fixed(column, width: int) -> np.ndarray:
    """Rows of a list column of that width."""
    at = column.offsets.to_numpy()
    return padded(column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], np.diff(at), width)


def _lists(m: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel(), kind))


def _round(books: list[np.ndarray], moves: list[Movement] | None, width: int, last: bool):
    """Rows (vec_id, label, v), or with their state, to their state under the codebooks; the last time to (vec_id, label, code, error)."""
    parts, w = len(books), width // len(books)

    def run(batches):
        for b in batches:
            n = len(b)
            x = integers(b.column("v"), width, SCALE) if moves is None else _fixed(b.column("x"), width)
            out, size = [], books[0].shape[0]
            if moves is not None:
                codes, bounds = _fixed(b.column("code"), parts), _fixed(b.column("bounds"), 3 * parts)
                half = (size + 1) // 2
                packed = np.frombuffer(b"".join(b.column("lower").to_pylist()), np.uint8).reshape(n, parts, half)
            for p in range(parts):
                y = x[:, p * w : (p + 1) * w]
                if moves is None:
                    out.append(first(y, books[p]))
                else:
                    lower = unpack(bounds[:, 3 * p + 1], bounds[:, 3 * p + 2], packed[:, p], size)
                    out.append(again(y, moves[p], codes[:, p], bounds[:, 3 * p], lower)[:3])
            code = np.stack([o[0] for o in out], axis=1)
            if last:
                error = sum(((x[:, p * w : (p + 1) * w] - books[p][code[:, p]]) ** 2).sum(axis=1) for p in range(parts))
                digits = code.astype(">u2" if size > 256 else np.uint8).tobytes().hex()
                each = len(digits) // n if n else 0
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([digits[i * each : (i + 1) * each] for i in range(n)], pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])
                continue
            tight = [pack(o[2]) for o in out]
            bounds = np.stack([c for o, t in zip(out, tight, strict=True) for c in (o[1], t[0], t[1])], axis=1)
            low = np.concatenate([t[2] for t in tight], axis=1)
            lower = pa.array([r.tobytes() for r in low], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), _lists(x, pa.int64()), _lists(code, pa.int32()), _lists(bounds, pa.float64()), lower], ["vec_id", "label", "x", "code", "bounds", "lower"])

    return run


def _totals(parts: int, entries: int, width: int):
    """Sums of the parts of each entry, and their numbers, as one array."""
    w = width // parts

    def run(batches):
        total = np.zeros((parts, entries, w + 1), np.int64)
        for b in batches:
            x, code = _fixed(b.column("x"), width), _fixed(b.column("code"), parts)
            for p in range(parts):
                order = np.argsort(code[:, p], kind="stable")
                c = code[order, p]
                cuts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)
                if len(cuts):
                    total[p, c[cuts], :w] += np.add.reduceat(x[order, p * w : (p + 1) * w], cuts, axis=0)
                    total[p, c[cuts], w] += np.diff([*cuts, len(c)])
        return total.ravel()

    return run


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components of the codebooks as decimals, by part, entry and place."""
    return hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()


def codes(df: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", blocks: int = BLOCKS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of every sound vector, written, and the codebooks (a matrix for each part)."""
    spark = df.sparkSession
    vecs = kept(df, vector_col, vec_id=id_col, label=label_col)
    kinds = [f"{c} {vecs.schema[c].dataType.simpleString()}" for c in ("vec_id", "label")]
    done = ", ".join([*kinds, "code string", "error long"])
    n, width = extent(vecs)
    if not n:
        return spark.createDataFrame([], done), []
    width = max(parts, -(-width // parts) * parts)
    start = pa.array([r["v"] for r in vecs.orderBy(F.col("vec_id").isNull(), "vec_id", "v").limit(entries).select("v").collect()], pa.list_(pa.float64()))
    books = np.split(integers(start, width, SCALE), parts, axis=1)
    block = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks))
    states, moves = [(vecs.where(block == i), None) for i in range(blocks)], None
    for turn in range(rounds + 1):
        fresh, last = [], turn == rounds
        for rows, path in states:
            out, at = table(map_arrow(rows, _round(books, moves, width, last), done if last else ", ".join([*kinds, STATE])), "codes" if last else "bounds")
            fresh.append((out, at))
            if path:
                drop(spark, path)
        states = fresh
        if last:
            break
        paths = [at for _, at in states]
        seen = spark.read.schema(STATE).parquet(*paths).select("x", "code")
        total = summed(seen, _totals(parts, len(books[0]), width), parts * len(books[0]) * (width // parts + 1), "long").reshape(parts, len(books[0]), -1)
        new = [np.where(t[:, -1:] > 0, t[:, :-1] // np.maximum(t[:, -1:], 1), book) for t, book in zip(total, books, strict=True)]
        moves, books = [Movement(a, b) for a, b in zip(new, books, strict=True)], new
    return spark.read.schema(done).parquet(*[at for _, at in states]), books


def compress(df: DataFrame, **options) -> DataFrame:
    """vec_id, code, error, label_error (summed over equal labels), codebooks_sha256 of every sound vector."""
    rows, books = codes(df, **options)
    sums, _ = table(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    out = rows.join(small(sums.withColumnRenamed("label", "l")), F.col("label").eqNullSafe(F.col("l")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
