"""Suffix-array dedup: removal of long byte strings that occur more than once.

Every window of ``length`` bytes has an anchor: the least-hashed k-gram in it. Equal windows have equal anchors at
equal places, so only occurrences of one anchor have to be compared, each by its context: the bytes before and after
that its windows can reach. Occurrences whose whole contexts are equal repeat throughout. The others are resolved by
an enhanced suffix array of the anchor's suffixes: a stack scan over the common prefixes yields the interval tree, and
in each interval the left extensions are sorted and scanned in the same way; where they diverge, a maximal repeat
ends, which is reported with all its occurrences, not just neighbours.

An anchor with more than ``tree_limit`` different contexts is split into classes that share more bytes on its left or on
its right. If all of a class have a bytes before and b from the anchor on in common and ``length`` - a - b are lacking, a
repeated window starts within one of a few ranges of these, and who shares it has in common what lies before and after
that range; so every window is whole within a class. Classes are split until each fits a task's tree; a class that shares
``length`` bytes is a repeat group itself.

Contexts and equal texts are told apart by digests (62 and 128 bits). What a text's anchors and spans take is less than
the text.

Defined results: a null text counts as empty; texts shorter than ``length`` lose nothing; equal texts of that length
lose everything; matches never cross texts but may overlap within one; repeated rows are separate occurrences; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, map_arrow, release, table
from .hashing import Ranges, U, mix
from .texts import distinct_texts, small

PIECE = 1 << 20  # windows handled at once
TREE_LIMIT = 8192
WAYS = 4  # in which a class is split


def _least(key: np.ndarray, w: int) -> np.ndarray:
    """The least of every w neighbours, by prefix and suffix minima of blocks."""
    n = len(key) - w + 1
    pad = np.concatenate([key, np.full(-len(key) % w, ~U(0))]).reshape(-1, w)
    ahead = np.minimum.accumulate(pad, axis=1).ravel()
    back = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def _group(a: np.ndarray, spans: list[tuple[int, int]], length: int, k: int) -> tuple[np.ndarray, Ranges, np.ndarray]:
    """Anchors of the windows that start in the spans (start, end) of a, ascending; hashes of ranges; the k-grams' hashes."""
    ranges, at = Ranges(a), np.arange(len(a) - k + 1)
    grams = ranges(at, at + k)
    mask = U((1 << 22) - 1)
    least = _least((grams & ~mask) | at.astype(U), length - k + 1)
    starts = np.concatenate([least[s:e] for s, e in spans])
    found = (starts & mask).astype(np.int64)
    return found[np.concatenate([[True], found[1:] != found[:-1]])], ranges, grams


def anchors(texts: list[bytes], length: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, pos, hash of the anchor, hash of its context) arrays for the texts' anchors."""
    w = length - k
    batch: list[tuple[int, int, int, int, bytes]] = []  # row, offset of the slice in the text, first and last window in the slice, bytes

    def flush():
        a = np.frombuffer(b"".join(x[4] for x in batch), np.uint8)
        starts = np.cumsum([0, *[len(x[4]) for x in batch]])
        found, ranges, grams = _group(a, [(s + x[2], s + x[3]) for s, x in zip(starts, batch, strict=False)], length, k)
        piece = np.searchsorted(starts, found, side="right") - 1
        left = np.minimum(found - starts[piece], w)
        right = np.minimum(starts[piece + 1] - found, length)
        context = mix(ranges(found - left, found + right) + (left * 1024 + right).astype(U))
        rows = np.array([x[0] for x in batch])[piece]
        return rows, found - starts[piece] + np.array([x[1] for x in batch])[piece], grams[found].view(np.int64), context.view(np.int64)

    size, last = 0, {}
    for row, t in enumerate(texts):
        n = len(t) - length + 1
        for first in range(0, max(n, 0), PIECE):
            to = min(n, first + PIECE)
            begin = max(0, first - w)
            batch.append((row, begin, first - begin, to - begin, t[begin : to + 2 * length + w]))
            size += len(batch[-1][4])
            if size >= PIECE or n > PIECE:
                r, p, h, c = flush()
                batch, size = [], 0
                if n > PIECE:  # two pieces may share the anchor between them
                    new = (r != row) | (p > last.get(row, -1))
                    r, p, h, c = r[new], p[new], h[new], c[new]
                    if len(p):
                        last = {row: int(p[-1])}
                yield r, p, h, c
    if batch:
        yield flush()


def _common(m: np.ndarray, size: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of neighbours in that order, of zero-padded rows of given sizes."""
    x, y = m[order[1:]], m[order[:-1]]
    differ = np.concatenate([x != y, np.ones((len(x), 1), bool)], axis=1)
    return np.minimum(differ.argmax(axis=1), np.minimum(size[order[1:]], size[order[:-1]]))


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of the nodes of the interval tree over a suffix array with those common prefixes (stack scan)."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*lcp, 0]):
        first = i
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, i
        if depth and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def maximal_repeats(lefts: list[bytes], rights: list[bytes], length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(bytes before, bytes after, occurrences) of the maximal repeats of at least ``length`` bytes through an anchor.

    lefts are reversed. A node of the right tree whose occurrences all extend to the left by the same byte yields no
    repeat that ends there; where their left extensions diverge is a node of the left tree.
    """
    if len(rights) == 2:
        left, right = (_shared(*x) for x in (lefts, rights))
        if left + right >= length:
            yield left, right, np.arange(2)
        return
    wide = [np.frombuffer(b"".join(x.ljust(n, b"\0") for x in side), np.uint8).reshape(len(side), n) for side in (rights, lefts) for n in [max(1, *map(len, side))]]
    sizes = [np.array([len(x) for x in side]) for side in (rights, lefts)]
    suffixes = np.array(sorted(range(len(rights)), key=rights.__getitem__))
    rank = np.empty(len(lefts), np.int64)
    rank[sorted(range(len(lefts)), key=lefts.__getitem__)] = np.arange(len(lefts))
    most = int(sizes[1].max())
    for right, first, last in intervals(_common(wide[0], sizes[0], suffixes).tolist()):
        if right + most < length:
            continue
        node = suffixes[first : last + 1]
        node = node[np.argsort(rank[node])]
        for left, i, j in intervals(_common(wide[1], sizes[1], node).tolist()):
            if left + right >= length:
                yield left, right, node[i : j + 1]
        if right >= length:
            yield 0, right, node


def _shared(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    return int((np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n)).argmax())


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x.as_buffer().to_pybytes() for x in batch.column("text").cast(pa.large_binary())]


def _anchored(length: int, k: int):
    def run(batches):
        for b in batches:
            tid = b.column("tid").to_numpy()
            for r, p, h, c in anchors(_texts(b), length, k):
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), pa.array(tid[r]), pa.array(p.astype(np.int64))], ["h", "cx", "tid", "pos"])

    return run


def _contexts(length: int, k: int):
    """Rows (text, at: h, cx, pos of anchors) to rows (h, cx, left, right); left is reversed."""

    def run(batches):
        for b in batches:
            out = [], [], [], []
            for t, at in zip(_texts(b), b.column("at").to_pylist(), strict=True):
                for x in at:
                    p = x["pos"]
                    for to, v in zip(out, (x["h"], x["cx"], t[max(0, p - length + k) : p][::-1], t[p : p + length]), strict=True):
                        to.append(v)
                    if len(out[0]) >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], ["h", "cx", "left", "right"])
                        out = [], [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], ["h", "cx", "left", "right"])

    return run


def _trees(length: int, reach: bool):
    """Rows (c, h, cx, left, right) sorted by class c to the maximal repeats: (h, cx, before, after, c, repeat), a row for each occurrence.

    With reach only the furthest before and after of each occurrence, repeat null.
    """

    def run(batches):
        c, h, cx, lefts, rights = None, None, [], [], []
        out: list[tuple] = []

        def close():
            if len(cx) < 2:
                return
            far = np.zeros((2, len(cx)), np.int64)
            for i, (before, after, who) in enumerate(maximal_repeats(lefts, rights, length)):
                if reach:
                    far[0, who] = np.maximum(far[0, who], before)
                    far[1, who] = np.maximum(far[1, who], after)
                else:
                    out.extend((h, cx[j], before, after, c, i) for j in who.tolist())
            out.extend((h, cx[j], int(far[0, j]), int(far[1, j]), c, None) for j in np.flatnonzero(far[1]).tolist())

        def flush():
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["h", "cx", "before", "after", "c", "repeat"])

        for b in batches:
            for k, g, x, left, right in zip(*(b.column(n).to_pylist() for n in ("c", "h", "cx", "left", "right")), strict=True):
                if k != c:
                    close()
                    c, h, cx, lefts, rights = k, g, [], [], []
                    if len(out) >= 20_000:
                        yield flush()
                cx.append(x)
                lefts.append(left)
                rights.append(right)
        close()
        if out:
            yield flush()

    return run


def _classes(contexts: DataFrame, big: DataFrame, length: int, k: int, limit: int) -> tuple[list[DataFrame], list[DataFrame], list[str]]:
    """(classes (c, h, cx, left, right) of at most so many contexts, groups of what shares ``length`` bytes, written paths); big has the anchors h to split."""
    spark = contexts.sparkSession
    rest, path = table(contexts.join(small(big), "h").select(F.col("h").alias("c"), F.lit(0).alias("a"), F.lit(k).alias("b"), "h", "cx", "left", "right"), "classes")
    parts, groups, paths = [], [], [path]
    while True:
        lacking = F.lit(length) - F.col("a") - F.col("b")
        cut = lambda i: F.floor((lacking + 1) * i / WAYS).cast("int")
        ranges = F.array(*[F.struct((F.col("a") + cut(i)).alias("a"), (F.col("b") + lacking - cut(i + 1) + 1).alias("b"), (cut(i) < cut(i + 1)).alias("some")) for i in range(WAYS)])
        more = F.explode(F.filter(ranges, lambda x: x["some"]))
        split = rest.select("c", "h", "cx", "left", "right", more.alias("m")).where((F.octet_length("left") >= F.col("m.a")) & (F.octet_length("right") >= F.col("m.b")))
        c = F.xxhash64("c", "m.a", "m.b", F.expr("substring(left, 1, m.a)"), F.expr("substring(right, 1, m.b)"))
        rest, path = table(split.select(c.alias("c"), "m.a", "m.b", "h", "cx", "left", "right"), "classes")
        paths.append(path)
        sizes, path = table(rest.groupBy("c").agg(F.count("*").alias("m"), (F.first("a") + F.first("b") >= length).alias("whole")).where("m > 1"), "class-sizes")
        paths.append(path)
        # what shares all bytes is a group; what fits a task goes to the trees; the others are split again
        whole, large = sizes.where("whole").select("c"), sizes.where(f"not whole and m > {limit}").select("c")
        groups.append(rest.join(small(whole), "c").select("h", "cx", F.col("a").cast("long").alias("before"), F.col("b").cast("long").alias("after"), "c", F.lit(0).cast("long").alias("repeat")))
        parts.append(rest.join(small(sizes.where(f"not whole and m <= {limit}").select("c")), "c").select("c", "h", "cx", "left", "right"))
        if large.isEmpty():
            return parts, groups, paths
        rest = rest.join(small(large), "c")


def _merge(batches):
    """Rows (tid, spans) to the unions of the spans: (tid, starts, ends)."""
    for b in batches:
        starts, ends = [], []
        for spans in b.column("spans"):
            v = spans.values
            s, e = (np.asarray(v.field(i)) for i in (0, 1))
            o = np.argsort(s, kind="stable")
            s, e = s[o], np.maximum.accumulate(e[o])
            new = np.concatenate([[True], s[1:] > e[:-1]])
            starts.append(s[new])
            ends.append(e[np.concatenate([new[1:], [True]])])
        yield pa.RecordBatch.from_arrays([b.column("tid"), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], ["tid", "starts", "ends"])


def _kept(length: int):
    """Rows (key, text, n_rows, starts, ends) to (key, n_bytes, kept, starts, ends)."""

    def run(batches):
        for b in batches:
            rows = []
            for t, n, s, e in zip(_texts(b), *(b.column(c).to_pylist() for c in ("n_rows", "starts", "ends")), strict=True):
                if n > 1 and len(t) >= length:
                    s, e = [0], [len(t)]
                s, e = s or [], [min(x, len(t)) for x in e or []]
                rows.append((len(t), b"".join(t[i:j] for i, j in zip([0, *e], [*s, len(t)], strict=True)), s, e))
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("key"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["key", "n_bytes", "kept", "starts", "ends"])

    return run


def repeat_groups(texts: DataFrame, length: int = 200, k: int = 64, tree_limit: int = TREE_LIMIT, reach: bool = False) -> tuple[DataFrame, DataFrame, list[str]]:
    """Repeats in texts (tid, text): (anchors (h, cx, tid, pos), groups (h, cx, before, after, c, repeat), written paths).

    The bytes pos - before to pos + after of an anchor's occurrence are an occurrence of the repeat (c, repeat); those of
    contexts that occur more than once are given with c and repeat null. Groups are clipped to an anchor's context, so a
    longer maximal repeat is in several of them, as is one whose occurrences share several classes. With reach, the
    groups of a class are summed up to how far an occurrence's repeats go.
    """
    spark = texts.sparkSession
    every, every_path = table(map_arrow(texts.select("tid", "text"), _anchored(length, k), "h long, cx long, tid long, pos long"), "anchors")
    often, often_path = table(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "often")
    found, found_path = table(every.join(often.hint("merge"), "h"), "found")
    drop(spark, every_path, often_path)
    release(spark)
    by = found.groupBy("h", "cx").agg(F.count("*").alias("n"), F.min(F.struct("tid", "pos")).alias("one"))
    by, by_path = table(by.select("h", "cx", "n", "one.tid", "one.pos"), "contexts")
    wide, wide_path = table(by.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"), "mixed")
    at = by.join(wide.select("h").hint("merge"), "h").groupBy("tid").agg(F.collect_list(F.struct("h", "cx", "pos")).alias("at"))
    near, near_path = table(map_arrow(texts.select("tid", "text").join(at.hint("merge"), "tid").select("text", "at"), _contexts(length, k), "h long, cx long, left binary, right binary"), "sides")
    release(spark)
    big, big_path = table(wide.where(F.col("m") > tree_limit).select("h"), "big")
    parts, groups, paths = [near.select(F.col("h").alias("c"), "h", "cx", "left", "right")], [], []
    if not big.isEmpty():
        # few: each has more than tree_limit contexts
        more, groups, paths = _classes(near, big, length, k, tree_limit)
        parts = [parts[0].join(small(big), "h", "left_anti").select("c", "h", "cx", "left", "right"), *more]
    rows = reduce(DataFrame.unionByName, parts).repartition("c").sortWithinPartitions("c")
    trees = map_arrow(rows, _trees(length, reach), "h long, cx long, before long, after long, c long, repeat long")
    # a context that occurs again is a repeat as a whole; how far it reaches is clipped to the text when spans are cut
    none = F.lit(None).cast("long")
    whole = by.where("n > 1").select("h", "cx", F.lit(length - k).cast("long").alias("before"), F.lit(length).cast("long").alias("after"), none.alias("c"), none.alias("repeat"))
    out, out_path = table(reduce(DataFrame.unionByName, [trees, *groups, whole]), "repeats")
    drop(spark, by_path, wide_path, near_path, big_path, *paths)
    return found, out, [found_path, out_path]


def _removed(docs: DataFrame, length: int, k: int, id_col: str, text_col: str, tree_limit: int) -> tuple[DataFrame, DataFrame, str]:
    """(doc_id, key) of every row, and (key, n_bytes, kept, spans) of every text; both written, the second to that path."""
    spark = docs.sparkSession
    texts, texts_path, rows, _ = distinct_texts(docs, id_col, text_col)
    found, groups, paths = repeat_groups(texts, length, k, tree_limit, reach=True)
    # written, so that the join's sides are plain shuffles and an occurrence in very many texts can be split
    reach, reach_path = table(groups.groupBy("h", "cx").agg(F.max("before").alias("before"), F.max("after").alias("after")), "reach")
    spans = found.join(reach.hint("merge"), ["h", "cx"]).select("tid", F.greatest(F.col("pos") - F.col("before"), F.lit(0)).alias("s"), (F.col("pos") + F.col("after")).alias("e"))
    spans = map_arrow(spans.groupBy("tid").agg(F.collect_list(F.struct("s", "e")).alias("spans")), _merge, "tid long, starts array<long>, ends array<long>")
    spans, spans_path = table(spans, "spans")
    release(spark)
    out = texts.join(spans.hint("merge"), "tid", "left").select("key", "text", "n_rows", "starts", "ends")
    out, path = table(map_arrow(out, _kept(length), "key string, n_bytes long, kept binary, starts array<long>, ends array<long>"), "kept")
    drop(spark, texts_path, spans_path, reach_path, *paths)
    span = F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end"))
    return rows, out.select("key", "n_bytes", "kept", span.alias("spans")), path


def cleaned(docs: DataFrame, length: int = 200, k: int = 64, id_col: str = "doc_id", text_col: str = "text", tree_limit: int = TREE_LIMIT) -> DataFrame:
    """doc_id, n_bytes, kept (bytes: a cut may split a character), spans (array of start, end in bytes): every byte of a string of ``length`` bytes that starts elsewhere too is removed."""
    rows, out, path = _removed(docs, length, k, id_col, text_col, tree_limit)
    out, _ = table(out.dropDuplicates(["key"]), "cleaned")  # written, so that a text of very many rows can be split
    drop(docs.sparkSession, path)
    return rows.join(out, "key").select("doc_id", "n_bytes", "kept", "spans")


def dedup(docs: DataFrame, length: int = 200, k: int = 64, id_col: str = "doc_id", text_col: str = "text", tree_limit: int = TREE_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of what ``cleaned`` gives: digests are taken before rows are joined, so texts don't move."""
    rows, out, path = _removed(docs, length, k, id_col, text_col, tree_limit)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    out = out.select("key", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    out, _ = table(out.dropDuplicates(["key"]), "digests")
    drop(docs.sparkSession, path)
    return rows.join(out, "key").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
