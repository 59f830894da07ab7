"""Exact top-k inner products through an impact-ordered index, score at a time.

Candidates are indexed in groups of a bounded number of vectors. A posting is a place in the group and one component's
value there; zeros have none. Its impact is its absolute value, quantised by powers of the root of two. A segment holds
all postings of one quantised impact, component by component. Segments are processed by descending impact: each adds its
postings' products to the accumulators of a block of queries, and takes their components out of what is left of the
query and of the candidate. What the later postings can still add is at most the product of the norms of both
remainders (and a bound on rounding). Processing stops only when that proves which few candidates may be members; those
are rescored exactly in integers, whatever their size.

Groups are of neighbours: each vector belongs to the nearest of a bounded number of vectors (``CELLS`` at most), a cell with
very many is cut into several groups. Every query goes to one group of the cell whose middle suits it best; the k-th
score that it finds there is its threshold. Then it goes to those groups only whose best possible score, by the query's
product with the middle and its norm times the cell's radius, isn't below the threshold. Where vectors are clustered these
are few; where they aren't, as on Gaussian ones, bounds rule nothing out and all pairs of query and group are left.
Queries are sent to the groups' tasks through a shuffle and read as a stream, so neither the driver nor a task holds more
of them than a batch. A group passes on the best k of each query, so what meets for a query grows with the groups.

Defined results: vectors that are null or hold null or non-finite components, and rows with a null id, take no part;
rows with the query's own id are never its results; repeated query rows give repeated results; vectors of different
lengths are compared as if padded by zeros; an empty table gives no rows; extra columns are ignored. A score beyond 64
bits is cut to the largest or smallest long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, drop, map_arrow, table

GROUP = 16_384  # candidates indexed at once, about: as many as this, or fewer where cores would idle
LEAST_GROUP = 4096
CELLS = 1024  # middles of groups at most
QUERIES = 64  # that go through an index together
FEW = 32  # possible members a query that are rescored at once
PAIRS = 65_536  # rescored at once
ROUNDING = 2.0**-52
WORTH = 0.25  # of all candidates' squared norms: while more is left, what it may add proves nothing


class Index:
    """Postings of integer vectors in segments by descending quantised impact."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.order = np.argsort(ids, kind="stable")
        at, component = np.nonzero(x)
        value = x[at, component].astype(np.float64)
        impact = np.floor(2 * np.log2(np.abs(value))).astype(np.int64)
        by = np.lexsort((at, component, -impact))
        at, component, value, impact = at[by], component[by], value[by], impact[by]
        cuts = [0, *(np.flatnonzero((np.diff(impact) != 0) | (np.diff(component) != 0)) + 1).tolist(), len(at)]
        #: (squared norms of what comes after, [(component, places, values)]) by descending impact
        self.segments: list[tuple[np.ndarray, list]] = []
        rest, last = np.zeros(len(x)), None
        for i, j in zip(cuts[-2::-1], cuts[:0:-1], strict=True):  # ascending, so that nothing is lost to rounding
            if j == i:
                continue
            if impact[i] != last:
                last = impact[i]
                self.segments.append((rest.copy(), []))
            self.segments[-1][1].append((int(component[i]), at[i:j], value[i:j]))
            rest[at[i:j]] += value[i:j] ** 2
        self.segments.reverse()
        self.norm = np.sqrt(rest)
        self.processed = 0  # segments, over all blocks of queries

    def own(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, query) where a candidate has the query's id."""
        sorted_ids = self.ids[self.order]
        a, z = np.searchsorted(sorted_ids, ids), np.searchsorted(sorted_ids, ids, side="right")
        return self.order[np.concatenate([np.arange(i, j) for i, j in zip(a, z, strict=True)]).astype(np.int64)], np.repeat(np.arange(len(ids)), z - a)

    def possible(self, ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, place) pairs that may be among a query's best k; all others are proven not to be."""
        wide = np.ascontiguousarray(q.T.astype(np.float64))
        norm = np.sqrt((wide**2).sum(axis=0))
        rounding = ROUNDING * (2 * len(wide) + 16)
        error = rounding * self.norm[:, None] * norm
        sums, left = np.zeros((len(self.x), len(q))), np.tile(norm**2, (len(self.x), 1))
        own = self.own(ids)
        n, whole = len(self.x), (self.norm**2).sum()
        may = np.ones(sums.shape, bool)
        for rest, postings in self.segments:
            for component, at, value in postings:
                if component < len(wide):
                    sums[at] += value[:, None] * wide[component]
                    left[at] -= wide[component] ** 2
            self.processed += 1
            if rest.sum() > WORTH * whole:
                continue
            slack = np.sqrt(np.maximum(left, 0) + rounding * norm**2) * np.sqrt(rest * (1 + rounding))[:, None] + error
            sums[own] = -np.inf
            if n > k:
                floor = np.partition(sums - slack, n - k, axis=0)[n - k]
                may = sums + slack >= floor
                if may.sum() <= FEW * len(q):
                    break
        may[own] = False
        place, query = np.nonzero(may)
        return query, place


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise integer inner products."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1]) < 2**62:
        return (q * x).sum(axis=1)
    top = 2**63 - 1
    return np.array([min(top, max(-top - 1, sum(int(a) * int(b) for a, b in zip(u, v, strict=True)))) for u, v in zip(q, x, strict=True)], np.int64)


def _best(q: np.ndarray, id_: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The best k of each query among (query, id, score) rows, ties to smaller ids."""
    o = np.lexsort((id_, ~score, q))  # ~ turns the order of all longs round
    q, id_, score = q[o], id_[o], score[o]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], id_[keep], score[keep]


def _matrix(values: pa.ListArray, width: int | None = None) -> np.ndarray:
    """Vectors as rows, padded by zeros to the longest or cut to a width."""
    flat, at = values.values.to_numpy(zero_copy_only=False), values.offsets.to_numpy()
    n = np.diff(at)
    width = int(n.max(initial=0)) if width is None else width
    if len(n) and (n == width).all():
        return flat[at[0] : at[-1]].reshape(-1, width).astype(np.int64)
    out = np.zeros((len(n), width), np.int64)
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        out[i, : min(b - a, width)] = flat[a : min(b, a + width)]
    return out


def _search(k: int):
    """Rows (g, kind, rid, vec_id, v) by group, candidates (kind 0) before queries, to the best k of each query in each group: (q, query_id, vec_id, score)."""

    def run(batches):
        group, parts, index = None, [], None
        for b in batches:
            g, kind = b.column("g").to_numpy(), b.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(g) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(b)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                if g[i] != group:
                    group, parts, index = g[i], [], None
                part = b.slice(i, j - i)
                if kind[i] == 0:
                    parts.append((part.column("vec_id").to_numpy(), _matrix(part.column("v"))))
                    continue
                if not parts and index is None:
                    continue
                if index is None:
                    width = max(m.shape[1] for _, m in parts)
                    x = np.concatenate([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for _, m in parts])
                    index, parts = Index(np.concatenate([p[0] for p in parts]), x), []
                for at in range(0, len(part), QUERIES):
                    some = part.slice(at, QUERIES)
                    rid, ids, q = some.column("rid").to_numpy(), some.column("vec_id").to_numpy(), _matrix(some.column("v"), index.x.shape[1])
                    a, c = index.possible(ids, q, k)
                    # pieces bound what is held at once where very many tie
                    score = np.concatenate([np.zeros(0, np.int64), *[exact(q[a[s : s + PAIRS]], index.x[c[s : s + PAIRS]]) for s in range(0, len(a), PAIRS)]])
                    a, id_, score = _best(a, index.ids[c], score, k)
                    yield pa.RecordBatch.from_arrays([pa.array(z) for z in (rid[a], ids[a], id_, score)], ["q", "query_id", "vec_id", "score"])

    return run


SLACK = 1e-9  # beyond all rounding of products and norms


class Cells:
    """Middles of cells, their radii, how many groups each is cut into, and the number of its first group."""

    def __init__(self, middles: np.ndarray):
        self.middles = middles.astype(np.float64)
        self.squares = (self.middles**2).sum(axis=1)
        self.radius = np.zeros(len(middles))
        self.subs = self.base = np.zeros(len(middles), np.int64)

    def measured(self, found, group: int) -> Cells:
        """With the (cell, n, far) of the rows in them."""
        n = np.zeros(len(self.middles), np.int64)
        for cell, count, far in found:
            n[cell], self.radius[cell] = count, far
        self.subs = -(-n // group)
        self.base = np.cumsum(self.subs) - self.subs
        return self

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each row, and its distance from the middle, rounded up."""
        cell = (2 * (x @ self.middles.T) - self.squares).argmax(axis=1)
        return cell, np.sqrt(((x - self.middles[cell]) ** 2).sum(axis=1)) * (1 + SLACK)

    def most(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and cell the product with the middle, and what no member's score exceeds."""
        product = q @ self.middles.T
        norm = np.sqrt((q**2).sum(axis=1))[:, None]
        return product, product + norm * self.radius + SLACK * norm * (np.sqrt(self.squares) + self.radius) + 1

    def home(self, q: np.ndarray) -> np.ndarray:
        """The group that each query meets first."""
        return self.base[np.where(self.subs > 0, q @ self.middles.T, -np.inf).argmax(axis=1)]

    def others(self, q: np.ndarray, home: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, group) of all further groups that may have a score of at least the query's least."""
        row, cell = np.nonzero((self.most(q)[1] >= least[:, None]) & (self.subs > 0))
        each = self.subs[cell]
        group = np.repeat(self.base[cell] - np.cumsum(each) + each, each) + np.arange(int(each.sum()))
        row = np.repeat(row, each)
        new = group != home[row]
        return row[new], group[new]


def _placed(cells: Cells):
    """Rows (rid, vec_id, v) with their cell and distance from its middle."""

    def run(batches):
        for b in batches:
            cell, far = cells.nearest(_matrix(b.column("v"), cells.middles.shape[1]).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("rid", "vec_id", "v")), pa.array(cell), pa.array(far)], ["rid", "vec_id", "v", "cell", "far"])

    return run


def _first(cells: Cells):
    """Queries (rid, vec_id, v) with the group that they meet first."""

    def run(batches):
        for b in batches:
            home = cells.home(_matrix(b.column("v"), cells.middles.shape[1]).astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array(home), *(b.column(c) for c in ("rid", "vec_id", "v"))], ["g", "rid", "vec_id", "v"])

    return run


def _further(cells: Cells):
    """Queries (rid, vec_id, v, home, least: null without a threshold) to a row for each further group that they meet."""

    def run(batches):
        for whole in batches:
            for b in (whole.slice(i, 256) for i in range(0, len(whole), 256)):
                least = b.column("least").cast(pa.float64(), safe=False).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                row, group = cells.others(_matrix(b.column("v"), cells.middles.shape[1]).astype(np.float64), b.column("home").to_numpy(), least)
                for i in range(0, len(row), 4096):
                    at = pa.array(row[i : i + 4096])
                    yield pa.RecordBatch.from_arrays([pa.array(group[i : i + 4096]), *(b.column(c).take(at) for c in ("rid", "vec_id", "v"))], ["g", "rid", "vec_id", "v"])

    return run


ROWS = "g long, rid long, vec_id long, v array<long>"


def _met(candidates: DataFrame, queries: DataFrame, groups: int, k: int) -> DataFrame:
    """The best k of each query in each group that it is sent to, written, with the path."""
    kind = lambda df, n: df.select("g", F.lit(n).alias("kind"), "rid", "vec_id", "v")
    rows = kind(candidates, 0).unionByName(kind(queries, 1)).repartition(groups, "g").sortWithinPartitions("g", "kind")
    return table(map_arrow(rows, _search(k), "q long, query_id long, vec_id long, score long"), "found")


def top(df: DataFrame, every: int = 50, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row whose id is divisible by ``every``."""
    spark = df.sparkSession
    v = column(df, vector_col)
    sound = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    vecs = df.where(sound & column(df, id_col).isNotNull()).select(
        F.monotonically_increasing_id().alias("rid"), column(df, id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).alias("v")
    )
    vecs, vecs_path = table(vecs, "vectors")
    n, width = vecs.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    groups = max(1, -(-n // GROUP), min(2 * spark.sparkContext.defaultParallelism, n // LEAST_GROUP))
    some = vecs.orderBy(F.xxhash64("rid"), "rid").limit(min(groups, CELLS)).select("v").collect() or [[[]]]
    middles = _matrix(pa.array([r[0] for r in some], pa.list_(pa.int64())), max(1, width))
    cells = Cells(middles)
    placed, placed_path = table(map_arrow(vecs, _placed(cells), "rid long, vec_id long, v array<long>, cell long, far double"), "placed")
    drop(spark, vecs_path)
    size = -(-n // groups) if n else 1
    cells.measured(placed.groupBy("cell").agg(F.count("*"), F.max("far")).collect(), max(1, size))
    at = F.broadcast(spark.createDataFrame([(i, int(b), int(m)) for i, (b, m) in enumerate(zip(cells.base, cells.subs, strict=True))], "cell long, base long, subs long"))
    total = max(1, int(cells.subs.sum()))
    candidates = placed.join(at, "cell").select((F.col("base") + F.pmod(F.xxhash64("rid"), F.col("subs"))).alias("g"), "rid", "vec_id", "v")
    queries = placed.where(F.col("vec_id") % every == 0).select("rid", "vec_id", "v")
    asked, asked_path = table(map_arrow(queries, _first(cells), ROWS), "asked")
    near, near_path = _met(candidates, asked, total, k)
    least = near.groupBy("q").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    known = asked.join(least, F.col("rid") == F.col("q"), "left").select("rid", "vec_id", "v", F.col("g").alias("home"), "least")
    sent = map_arrow(known, _further(cells), ROWS)
    far, far_path = _met(candidates, sent, total, k)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    found, _ = table(near.unionByName(far).withColumn("rank", rank).where(F.col("rank") <= k), "best")
    drop(spark, placed_path, asked_path, near_path, far_path)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
