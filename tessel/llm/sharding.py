"""Sharding: minimax contiguous partition of ordered atomic groups (DataFrame functions only).

Groups are equal texts, ordered by a digest of the text. Prefix sums of their sizes are written once; the driver
keeps a bounded sketch of them (``bins`` cells of known smallest and largest prefix end), runs the greedy check on
it with lower and upper bounds, binary-searches the capacity, and refines only the cells that the answer still
depends on. A handful of jobs settles the exact capacity whatever the number of groups.

Defined results: a null text counts as empty (size = overhead, CRC 0) and groups with empty texts; repeated rows are
separate rows of one group; fewer groups than shards leave the last shards empty; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, drop, table, text_key

SUBS = 1024  # slices of a shard in which rows get their slots
RUN = 1 << 16  # slots of equal rows that are made at once
FINE = 64  # cells of a mean shard, at least


class Prefixes:
    """Bounds on the prefix ends: sorted disjoint cells (least end, largest end, number of ends)."""

    def __init__(self, cells: list[tuple[int, int, int]], total: int):
        self.total = total
        self.set(cells)

    def set(self, cells):
        self.cells = sorted(cells)
        self.least = [c[0] for c in self.cells]

    def floor(self, t: int, high: bool) -> int:
        """A bound, from below or above, on the largest prefix end that is at most t."""
        i = bisect_right(self.least, t) - 1
        if i < 0:
            return 0
        least, most, n = self.cells[i]
        if most <= t:
            return most
        return least if n <= 2 or not high else min(most, t)

    def path(self, capacity: int, shards: int, high: bool, start: int = 0) -> list[int]:
        """Ends of the greedy shards from start on."""
        out, pos = [], start
        for _ in range(shards):
            pos = self.floor(pos + capacity, high)
            out.append(pos)
        return out

    def smallest(self, shards: int, high: bool, lo: int, hi: int) -> int:
        """The smallest capacity whose greedy path reaches the total."""
        while lo < hi:
            mid = (lo + hi) // 2
            if self.path(mid, shards, high)[-1] >= self.total:
                hi = mid
            else:
                lo = mid + 1
        return lo


def _cells(ends: DataFrame, zones: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int]]:
    """Cells of the prefix ends within zones (inclusive bounds): the zones share ``bins``, but each is cut in two at least."""
    each = max(2, bins // len(zones))
    cell, keep = F.lit(None).cast("long"), F.lit(False)
    for i, (a, b) in enumerate(zones):
        here = F.col("end").between(a, b)
        keep = keep | here
        cell = F.when(here, F.lit(i * (each + 1)) + F.floor((F.col("end") - a) / -(-(b - a + 1) // each))).otherwise(cell)
    got = ends.where(keep).groupBy(cell.alias("cell")).agg(F.min("end"), F.max("end"), F.count("*")).collect()
    return [(r[1], r[2], r[3]) for r in got]


def _cuts(ends: DataFrame, total: int, largest: int, shards: int, bins: int) -> tuple[int, list[int]]:
    """The exact minimax capacity and, for it, the prefix ends after which to cut, as evenly as the sketch shows."""
    known = Prefixes(_cells(ends, [(1, total)], bins), total)
    lo, hi = max(largest, -(-total // shards)), total
    while True:
        lo = known.smallest(shards, True, lo, hi)
        hi = known.smallest(shards, False, lo, hi)
        low, high = known.path(lo, shards, False), known.path(hi, shards, True)
        zones, rest = [], []
        for c in known.cells:
            open_ = c[2] > 2 and any(a < c[1] and c[0] <= b + hi - lo for a, b in zip(low, high, strict=True))
            if not open_:
                rest.append(c)
            elif zones and zones[-1][1] == c[0] - 1:
                zones[-1] = (zones[-1][0], c[1])
            else:
                zones.append((c[0], c[1]))
        if lo == hi or not zones:
            break
        zones = _joined(zones, known.cells, 4 * shards)
        rest = [c for c in known.cells if not any(a <= c[0] and c[1] <= b for a, b in zones)]
        known.set(rest + _cells(ends, zones, bins))
    while zones := _wide(known, shards):
        rest = [c for c in known.cells if (c[0], c[1]) not in zones]
        known.set(rest + _cells(ends, sorted(zones), bins))
    return hi, _even(np.array(sorted({0, total, *(e for c in known.cells for e in c[:2])})), hi, shards)


def _wide(known: Prefixes, shards: int) -> set[tuple[int, int]]:
    """The widest cells that are too wide for even cuts: FINE of them are to make a mean shard.

    Known neighbours without ends between are one group's bounds. Groups larger than the mean of what the larger ones
    leave fill shards of their own and don't count to the mean.
    """
    at, groups = 0, []
    for least, most, n in known.cells:
        groups += [least - at] + [most - least] * (n == 2)
        at = most
    mean, rest, left = known.total / shards, known.total, shards
    for g in sorted(groups, reverse=True):
        if left == 1 or g <= mean:
            break
        rest, left = rest - g, left - 1
        mean = rest / left
    wide = [c for c in known.cells if c[2] > 2 and (c[1] - c[0]) * FINE > mean]
    return {(c[0], c[1]) for c in sorted(wide, key=lambda c: c[0] - c[1])[: 4 * shards]}


def _even(points: np.ndarray, capacity: int, shards: int) -> list[int]:
    """The cuts at points (from 0 to the total) with the least sum of squared shard sizes, none above capacity.

    Splitting a shard lessens that sum, so no shard stays empty while another could be split. The best start of a
    shard grows with its end, so a row of ends is solved by halving: starts lie between those of solved neighbours.
    """
    first = np.searchsorted(points, points - capacity)
    last = np.searchsorted(points, points + capacity, side="right") - 1
    high, low = [0], [len(points) - 1]  # of the points that can follow so many shards
    for _ in range(shards):
        high.append(int(last[high[-1]]))
        low.append(int(first[low[-1]]))
    low.reverse()
    at, cost, starts = points.astype(float), np.zeros(1), []
    for k in range(1, shards + 1):
        row = np.arange(low[k], high[k] + 1)
        lo, hi = np.maximum(first[row], low[k - 1]), np.minimum(row, high[k - 1])
        new, start = np.empty(len(row)), np.empty(len(row), np.int32)
        halves = [1 << i for i in reversed(range((len(row) - 1).bit_length()))]
        for some, step in [(np.zeros(1, np.int64), 0), *((np.arange(x, len(row), 2 * x), x) for x in halves)]:
            a, b = lo[some], hi[some]
            if step:
                a = np.maximum(a, start[some - step])
                inner = some + step < len(row)
                b[inner] = np.minimum(b[inner], start[some[inner] + step])
            n = b - a + 1
            begin = np.cumsum(n) - n
            tried = np.arange(n.sum()) + np.repeat(a - begin, n)
            sums = cost[tried - low[k - 1]] + (np.repeat(at[row[some]], n) - at[tried]) ** 2
            new[some] = np.minimum.reduceat(sums, begin)
            least = np.flatnonzero(sums == np.repeat(new[some], n))
            start[some] = tried[least[np.searchsorted(least, begin)]]
        cost = new
        starts.append(start)
    cuts, i = [], len(points) - 1
    for k in range(shards, 1, -1):
        i = int(starts[k - 1][i - low[k]])
        cuts.append(int(points[i]))
    return cuts[::-1]


def _joined(zones, cells, most):
    """At most so many zones: neighbours with the fewest cells between are joined."""
    while len(zones) > most:
        i = min(range(len(zones) - 1), key=lambda i: zones[i + 1][0] - zones[i][1])
        zones[i : i + 2] = [(zones[i][0], zones[i + 1][1])]
    return zones


def minimax_shards(df: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8, bins: int = 1 << 15) -> DataFrame:
    """Every row with its size, text CRC, shard and slot (law ``bytes``); equal texts share a shard.

    The largest shard is as small as any cut of the ordered groups allows. ``bins`` bounds what the driver holds.
    """
    spark = df.sparkSession
    text, id_ = column(df, text_col), column(df, id_col)
    raw = F.coalesce(text, F.lit("")).cast("binary")
    slim, slim_path = table(df.select(id_.alias("doc_id"), (F.octet_length(raw) + overhead).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), text_key(text).alias("key")), "shard-rows")
    groups = slim.groupBy("key").agg(F.sum("size").alias("bytes")).withColumn("bucket", F.substring("key", 1, 3))
    groups, groups_path = table(groups, "shard-groups")
    # 4,096 buckets of the digest at most, so their totals are small whatever the data
    totals = groups.groupBy("bucket").agg(F.sum("bytes").alias("sum"), F.max("bytes").alias("max")).orderBy("bucket").collect()
    total, largest = sum(r["sum"] for r in totals), max((r["max"] for r in totals), default=0)
    shard = F.lit(0)
    if total:
        offsets, at = [], 0
        for r in totals:
            offsets.append((r["bucket"], at))
            at += r["sum"]
        offsets = spark.createDataFrame(offsets, "bucket string, before long")
        run = F.sum("bytes").over(Window.partitionBy("bucket").orderBy("key"))
        ends, ends_path = table(groups.withColumn("run", run).join(F.broadcast(offsets), "bucket").select("key", (F.col("before") + F.col("run")).alias("end")), "shard-ends")
        _, cuts = _cuts(ends, total, largest, shards, bins)
        inner = sorted({c for c in cuts if 0 < c < total})
        last = [r["key"] for r in ends.where(F.col("end").isin(inner)).orderBy("end").collect()] if inner else []
        for key in last:
            shard = shard + F.when(F.col("key") > key, 1).otherwise(0)
        drop(spark, ends_path)
    drop(spark, groups_path)
    # rows that are equal in all that counts go by their number, so many of them don't meet in one slice
    equal = slim.groupBy("doc_id", "size", "text_crc32", "key").agg(F.count("*").alias("n"))
    placed = equal.withColumn("shard", shard.cast("int")).withColumn("sub", F.pmod(F.xxhash64("doc_id", "key"), F.lit(SUBS)).cast("int"))
    placed, _ = table(placed, "shard-placed")
    drop(spark, slim_path)
    counts = placed.groupBy("shard", "sub").agg(F.sum("n").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("sub")) - F.col("rows")
    counts = counts.select("shard", "sub", before.alias("before"))  # shards x SUBS rows at most
    run = Window.partitionBy("shard", "sub").orderBy("doc_id", "key").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("first", F.coalesce(F.sum("n").over(run), F.lit(0))).join(F.broadcast(counts), ["shard", "sub"]).withColumn("first", F.col("before") + F.col("first"))
    out = out.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))))
    out = out.withColumn("at", F.explode(F.sequence("at", F.least(F.col("at") + RUN, "n") - 1)))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
