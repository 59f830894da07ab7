"""Substring dedup by recompression: words of windows that occur earlier too are removed.

A document is a sequence of words, each named by its hash. A level of recompression replaces maximal runs of equal names
by one name and then pairs of a left and a right name by one (a bit of the name and the level tells which it is). Names
are hashes of what they stand for, so they are the same in all documents. What lies inside a window of ``window`` words
is named alike wherever the window occurs, except at its edges: the first and the last run may go on outside, a right
name at the start or a left name at the end may belong to a pair with a word outside. Without these, each window has on
every level a range of symbols that its words alone decide.

Spark goes through the corpus in rounds. A round counts the names of its level over all windows that are still alive: a
window with a symbol that occurs once in the corpus can't occur twice. What remains is revealed by shared symbols: each
window is anchored at the least-hashed symbol of its highest level, neighbouring windows with the same anchor are a
stretch. Equal stretches have equal digests of their words (124 bits, two polynomials of two lanes each); the earliest
one stays, all windows of the others are repeats. The earliest ones of stretches that differ but share an anchor are
compared window by window in the same way. Every step is a grouping; what it moves is linear in the words.

A symbol counts as repeated by a bitmap of fixed size with the names seen twice, which can let windows through but never
drops one that repeats.

Defined results: a null text has no words; texts with fewer words than a window lose nothing; a window is earlier in a
smaller doc_id, null being the smallest, or at a smaller place in the same one: rows with equal ids are one document in
this, so repeated rows don't remove each other; matches never cross rows but may overlap within one; an empty table gives
no rows; extra columns are ignored. Long texts are parsed in pieces that overlap by a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, drop, map_arrow, release, table
from .hashing import BASE, BLANK, PRIME, Ranges, U, mix, powers, reduced, runs
from .texts import small

ROUNDS = 3
PIECE = 1 << 20  # bytes, and windows, handled at once
MARKS = 1 << 27  # bits of the bitmap of repeated names
RUN, PAIR, SIDE = U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB)
PLACE = U((1 << 22) - 1)


def names_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The names of all words of one text, or of several with blanks between them, and where they start.

    Eight bytes at a time are mixed into a word's name, so words of at most eight bytes have names of their own.
    """
    a = np.frombuffer(b" " + text + b" " * 9, np.uint8)
    blank = BLANK[a]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray((len(a) - 8,), "<u8", a, strides=(1,))  # the bytes from each place on
    names = sizes.astype(U) * U(BASE)
    at, left, some = starts, sizes, None  # of the words that aren't at their end
    while len(at):
        part = eight[at]
        part &= U(0xFFFFFFFFFFFFFFFF) >> ((8 - np.minimum(left, 8)) * 8).astype(U)
        if some is None:
            names = mix(names ^ part)
            some = np.flatnonzero(left > 8)
            at, left = at[some] + 8, left[some] - 8
        else:
            names[some] = mix(names[some] * U(BASE) ^ part)
            more = left > 8
            some, at, left = some[more], at[more] + 8, left[more] - 8
    return names, starts - 1


class Spans(Ranges):
    """Digests of ranges of a sequence of names."""

    def __init__(self, names: np.ndarray):
        p = powers(len(names) + 1)
        self.sides = []
        for code, up, down in ((names % U(PRIME), p[0], p[1]), (mix(names) % U(PRIME), p[2], p[3])):
            sums = np.zeros(len(names) + 1, U)
            np.cumsum(reduced(code * up[: len(names)]), out=sums[1:])
            self.sides.append((sums, down))


def digests(names: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """124 bits of each range."""
    return tuple(Spans(x)(start, end).view(np.int64) for x in (names, mix(names ^ SIDE)))


class Piece:
    """Windows of some documents, and what recompression makes of them."""

    def __init__(self, names: np.ndarray, doc: np.ndarray, place: np.ndarray, window: int, last: int | None = None):
        """doc and place (in the document) of each word; windows start before last."""
        self.names, self.doc, self.place, self.window = names, doc, place, window
        n = max(0, len(names) - window + 1)
        at = np.arange(n if last is None else min(n, last))
        self.at = at[doc[at] == doc[at + window - 1]] if len(at) else at
        #: for each level the symbols and each window's range of them, from start to end
        self.levels = [(names, self.at, self.at + window)]
        self.of, self.fresh = doc, np.zeros(len(names), bool)

    def compress(self) -> None:
        """One level: runs, then pairs. What may be named otherwise elsewhere is taken from the windows' ranges first."""
        (sym, lo, hi), of, level = self.levels[-1], self.of, len(self.levels)
        to = np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
        if not len(sym):
            self.levels.append((sym, *to))
            return
        starts = np.concatenate([[True], (sym[1:] != sym[:-1]) | (of[1:] != of[:-1])])
        some = np.flatnonzero(hi > lo)
        if starts.all():
            fresh, lo, hi = np.zeros(len(sym), bool), lo[some] + 1, hi[some] - 1
        else:
            run, head = np.cumsum(starts) - 1, np.flatnonzero(starts)
            times = np.diff(head, append=len(sym))
            sym, of, fresh = sym[head], of[head], times > 1
            sym = np.where(fresh, mix(sym * RUN + times.astype(U) * U(BASE) + U(level)), sym)
            lo, hi = run[lo[some]] + 1, run[hi[some] - 1]
        right = mix(sym ^ U(int(SIDE) * level & (1 << 64) - 1)) >> U(63) == 1
        held = np.flatnonzero(lo < hi)
        some, lo, hi = some[held], lo[held], hi[held]
        lo, hi = lo + right[lo], hi - ~right[hi - 1]
        held = np.flatnonzero(lo < hi)
        some, lo, hi = some[held], lo[held], hi[held]
        pair = np.flatnonzero(~right[:-1] & right[1:] & (of[1:] == of[:-1]))
        sym, keep = sym.copy(), np.ones(len(sym), bool)
        sym[pair] = mix(sym[pair] * PAIR + mix(sym[pair + 1]) + U(level))
        fresh[pair], keep[pair + 1] = True, False
        new = np.cumsum(keep) - 1
        self.of, self.fresh = of[keep], fresh[keep]
        to[0][some], to[1][some] = new[lo], new[hi - 1] + 1
        self.levels.append((sym[keep], *to))

    def prune(self, marks: np.ndarray) -> None:
        """Windows with a new symbol that isn't marked are gone."""
        sym, lo, hi = self.levels[-1]
        new = np.flatnonzero(self.fresh)
        named = sym[new]
        known = (marks[((named & U(MARKS - 1)) >> U(6)).astype(np.int64)] >> (named & U(63))) & U(1) == 1
        gone = np.zeros(len(sym) + 1, np.int64)
        gone[new[~known] + 1] = 1
        gone = np.cumsum(gone)
        alive = np.flatnonzero(gone[hi] == gone[lo])
        if len(alive) < len(self.at):
            self.at = self.at[alive]
            self.levels = [(s, a[alive], z[alive]) for s, a, z in self.levels]

    def symbols(self) -> np.ndarray:
        """Names of the new symbols in the windows' ranges."""
        sym, lo, hi = self.levels[-1]
        held = np.flatnonzero(hi > lo)
        cover = np.bincount(lo[held], minlength=len(sym) + 1) - np.bincount(hi[held], minlength=len(sym) + 1)
        return sym[(np.cumsum(cover[:-1]) > 0) & self.fresh]

    def follow(self, rounds: int, marks: np.ndarray | None = None) -> Piece:
        """Compressed so many times; every level's marks take windows out."""
        for _ in range(rounds):
            self.compress()
            if marks is not None:
                self.prune(marks)
        return self

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Each window's anchor (place and level as one number) and its name: the least-hashed symbol on its highest level, of equal ones the first."""
        anchor, named = np.zeros(len(self.at), np.int64), np.zeros(len(self.at), U)
        open_ = np.arange(len(self.at))
        for level in range(len(self.levels) - 1, -1, -1):
            sym, lo, hi = self.levels[level]
            there = hi[open_] > lo[open_]
            some, open_ = open_[there], open_[~there]
            if len(some):
                at = _least(sym, level, lo[some], hi[some])
                anchor[some], named[some] = at * 64 + level, sym[at]
        return anchor, named

    def stretches(self) -> tuple[np.ndarray, ...]:
        """(doc, place, number of windows, anchor's name, digest) of neighbouring windows with one anchor."""
        (anchor, named), at = self.anchors(), self.at
        new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(anchor) != 0) | (np.diff(self.doc[at]) != 0)]) if len(at) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        size, start = np.diff(head, append=len(at)), at[head]
        return self.doc[start], self.place[start], size, named[head].view(np.int64), *digests(self.names, start, start + size + self.window - 1)


def _least(sym: np.ndarray, level: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Place of the least-hashed symbol in each range, none of them empty; of equal ones the first."""
    key = (mix(sym ^ U(level * BASE & (1 << 64) - 1)) & ~PLACE) | np.arange(len(sym)).astype(U)
    out, size, wide = np.zeros(len(lo), np.int64), hi - lo, 1
    while wide <= size.max():
        some = np.flatnonzero((size >= wide) & (size < 2 * wide))
        out[some] = (np.minimum(key[lo[some]], key[hi[some] - wide]) & PLACE).astype(np.int64)
        key = np.minimum(key[: max(len(key) - wide, 0)], key[wide:])  # of twice as many from each place on
        wide *= 2
    return out


def pieces(texts: list[bytes], window: int) -> Iterator[Piece]:
    """The texts' windows, each in one piece."""
    for i, j in runs([len(t) + 1 for t in texts], PIECE):
        joined, starts = names_of(b" ".join(texts[i:j]))
        sizes = np.diff(np.searchsorted(starts, np.cumsum([0, *[len(t) + 1 for t in texts[i:j]]])))
        doc = np.repeat(np.arange(i, j), sizes)
        place = np.arange(len(joined)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        for a in range(0, max(1, len(joined)), PIECE):
            z = min(len(joined), a + PIECE + window - 1)
            yield Piece(joined[a:z], doc[a:z], place[a:z], window, PIECE)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x.as_buffer().to_pybytes() for x in batch.column("text").cast(pa.large_binary())]


def _named(window: int, level: int, marks: np.ndarray | None):
    """Rows (text) to the names of the level's new symbols."""

    def run(batches):
        for b in batches:
            for p in pieces(_texts(b), window):
                for i in range(level):
                    p.compress()
                    if i < level - 1:
                        p.prune(marks)
                yield pa.RecordBatch.from_arrays([pa.array(p.symbols().view(np.int64))], ["name"])

    return run


def _stretched(window: int, rounds: int, marks: np.ndarray):
    """Rows (tid, doc_id, text) to (tid, doc_id, place, m, anchor, a, b)."""

    def run(batches):
        for b in batches:
            for p in pieces(_texts(b), window):
                doc, *rest = p.follow(rounds, marks).stretches()
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays([b.column("tid").take(at), b.column("doc_id").take(at), *map(pa.array, rest)], ["tid", "doc_id", "place", "m", "anchor", "a", "b"])

    return run


def _by_text(batches) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows (tid, kind, doc_id, text, s, e) by tid, the text (kind 0) first, to (text's row, s, e) of each tid."""
    none = np.zeros(0, np.int64)
    held, s, e = None, [none], [none]
    for b in batches:
        tid, kind = b.column("tid").to_numpy(), b.column("kind").to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(tid) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(b)]
        starts, ends = (b.column(c).fill_null(0).to_numpy() for c in "se")
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i < j and kind[i] == 0:
                if held is not None:
                    yield held, np.concatenate(s), np.concatenate(e)
                held, s, e = b.slice(i, 1), [none], [none]
            elif i < j:
                s.append(starts[i:j])
                e.append(ends[i:j])
    if held is not None:
        yield held, np.concatenate(s), np.concatenate(e)


def _streamed(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """texts (tid, doc_id, text) and rows (tid, s, e) as one stream by tid."""
    none = F.lit(None)
    both = texts.select("tid", F.lit(0).alias("kind"), "doc_id", "text", none.cast("long").alias("s"), none.cast("long").alias("e")).unionByName(
        rows.select("tid", F.lit(1).alias("kind"), none.cast(texts.schema["doc_id"].dataType).alias("doc_id"), none.cast("string").alias("text"), "s", "e")
    )
    return both.repartition("tid").sortWithinPartitions("tid", "kind")


def _windows(window: int):
    """A stream with stretches (place, number of windows) to their windows (tid, doc_id, place, a, b); many short texts go together."""

    def flush(held):
        rows, s, m = zip(*held, strict=True)
        texts = [_texts(r)[0] for r in rows]
        names, starts = names_of(b" ".join(texts))
        base = np.searchsorted(starts, np.cumsum([0, *[len(t) + 1 for t in texts]]))[:-1]
        row = np.repeat(np.arange(len(rows)), [len(x) for x in s])
        s, m = np.concatenate(s), np.concatenate(m)
        tid, doc_id = (pa.concat_arrays([r.column(c) for r in rows]) for c in ("tid", "doc_id"))
        for i, j in runs(m.tolist(), PIECE):
            at = np.repeat(s[i:j] - np.cumsum(m[i:j]) + m[i:j], m[i:j]) + np.arange(int(m[i:j].sum()))
            of = np.repeat(row[i:j], m[i:j])
            a, b = digests(names, base[of] + at, base[of] + at + window)
            of = pa.array(of)
            yield pa.RecordBatch.from_arrays([tid.take(of), doc_id.take(of), pa.array(at), pa.array(a), pa.array(b)], ["tid", "doc_id", "place", "a", "b"])

    def run(batches):
        held, size = [], 0
        for row, s, m in _by_text(batches):
            if len(s):
                held.append((row, s, m))
                size += row.nbytes
            if size >= PIECE:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return run


def merged(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unions of spans."""
    if not len(s):
        return s, e
    o = np.argsort(s, kind="stable")
    s, e = s[o], np.maximum.accumulate(e[o])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    return s[new], e[np.concatenate([new[1:], [True]])]


def _kept(batches):
    """A stream with removed spans to (doc_id, n_words, kept, starts, ends)."""
    out: list[tuple] = []
    size = 0

    def flush():
        ids, n, kept, s, e = zip(*out, strict=True)
        cols = [pa.concat_arrays(ids), pa.array(n, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(s, pa.list_(pa.int64())), pa.array(e, pa.list_(pa.int64()))]
        out.clear()
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "kept", "starts", "ends"])

    for row, s, e in _by_text(batches):
        text = _texts(row)[0]
        words = text.split()
        s, e = merged(s, e)
        kept = b" ".join(words if not len(s) else [w for i, j in zip([0, *e.tolist()], [*s.tolist(), len(words)], strict=True) for w in words[i:j]])
        out.append((row.column("doc_id"), len(words), kept, s, e))
        size += len(kept)
        if len(out) >= 1000 or size > PIECE:
            yield flush()
            size = 0
    if out:
        yield flush()


def _bitmap(names: DataFrame, marks: np.ndarray | None) -> np.ndarray:
    """The bitmap with the low bits of those names set too."""
    at = F.col("name").bitwiseAND(F.lit(MARKS - 1))
    words = names.groupBy(F.shiftright(at, 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(name & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(MARKS // 64, U) if marks is None else marks
    out[words["word"].to_numpy()] |= words["bits"].to_numpy().view(U)
    return out


def _compared(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """The rows whose digest is among firsts, and whether its first occurrence is before them."""
    return rows.join(firsts.select("a", "b", "first").hint("merge"), ["a", "b"]).withColumn("later", ~F.col("doc_id").eqNullSafe(F.col("first.doc_id")) | (F.col("place") > F.col("first.place")))


def repeated(texts: DataFrame, window: int = 20, rounds: int = ROUNDS) -> tuple[DataFrame, list[str]]:
    """(tid, s, e): spans of words of texts (tid, doc_id, text) that cover all windows that occur earlier and no others; and the written paths."""
    spark = texts.sparkSession
    kind = texts.schema["doc_id"].dataType.simpleString()
    marks = None
    for level in range(1, rounds + 1):
        found = map_arrow(texts.select("text"), _named(window, level, marks), "name long")
        again, path = table(found.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name"), "names")
        marks = _bitmap(again, marks)
        drop(spark, path)
        release(spark)
    rows, rows_path = table(map_arrow(texts, _stretched(window, rounds, marks), f"tid long, doc_id {kind}, place long, m long, anchor long, a long, b long"), "stretches")
    first = F.min(F.struct("doc_id", "place", "tid")).alias("first")
    firsts, firsts_path = table(rows.groupBy("a", "b").agg(first, F.count("*").alias("n"), F.min("anchor").alias("anchor"), F.min("m").alias("m")), "firsts")
    release(spark)
    # of repeated rows none is before the other: those beside the first are compared on as it is
    others, others_path = table(_compared(rows, firsts.where("n > 1")).where(F.col("later") | (F.col("tid") != F.col("first.tid"))).select("tid", "place", "m", "anchor", "later"), "others")
    drop(spark, rows_path)
    release(spark)
    # different stretches with one anchor may share windows
    mixed, mixed_path = table(firsts.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor"), "mixed")
    earliest = firsts.select("anchor", "first.tid", "first.place", "m").unionByName(others.where("not later").select("anchor", "tid", "place", "m"))
    open_, open_path = table(earliest.join(mixed.hint("merge"), "anchor").select("tid", F.col("place").alias("s"), F.col("m").alias("e")), "open")
    drop(spark, firsts_path, mixed_path)
    release(spark)
    who, who_path = table(open_.select("tid").distinct(), "who")
    windows = map_arrow(_streamed(texts.join(small(who), "tid"), open_), _windows(window), f"tid long, doc_id {kind}, place long, a long, b long")
    windows, windows_path = table(windows, "windows")
    drop(spark, open_path, who_path)
    release(spark)
    earliest, earliest_path = table(windows.groupBy("a", "b").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("n")).where("n > 1"), "earliest")
    spans = others.where("later").select("tid", F.col("place").alias("s"), (F.col("place") + F.col("m") + (window - 1)).alias("e"))
    more = _compared(windows, earliest).where("later").select("tid", F.col("place").alias("s"), (F.col("place") + window).alias("e"))
    out, out_path = table(spans.unionByName(more), "spans")
    drop(spark, others_path, windows_path, earliest_path)
    release(spark)
    return out, [out_path]


def cleaned(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, kept (words joined by blanks), spans (array of start, end in words) for every row of docs."""
    spark = docs.sparkSession
    texts = docs.select(F.monotonically_increasing_id().alias("tid"), column(docs, id_col).alias("doc_id"), F.coalesce(column(docs, text_col), F.lit("")).alias("text"))
    texts, texts_path = table(texts, "texts")
    spans, paths = repeated(texts, window, rounds)
    kind = texts.schema["doc_id"].dataType.simpleString()
    out = map_arrow(_streamed(texts, spans), _kept, f"doc_id {kind}, n_words long, kept string, starts array<long>, ends array<long>")
    out, _ = table(out.select("doc_id", "n_words", "kept", F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end")).alias("spans")), "kept-words")
    drop(spark, texts_path, *paths)
    return out


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of what ``cleaned`` gives."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return cleaned(docs, **options).select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
