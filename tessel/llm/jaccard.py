"""N-gram Jaccard join through PartEnum signatures.

Sets of word shingles fall into size bands; in a band, sets that are similar enough differ in at most K elements. The
hashed domain is cut into n1 partitions of n2 parts, so that in some partition at most k2 parts differ; a signature is
what a set holds in one partition's parts without some k2 of them. Sets that link therefore share a signature. Shingles
have hashes of 62 bits up to there; sizes of sets and every pair are verified on the words themselves, so a collision
can't make a link, and could hide one only among shingles that collide. Buckets count as having the same members, and
are compared once, if number, sum and two xors of hashes of their members agree (over 150 bits).

Pairs are found without emitting all pairs of a bucket: members are first compared with one member of their bucket,
the one that shares most buckets; links are contracted to components, and only buckets that still span several components go
on, with a bounded block of further members as centres each round, until every pair across components has been
compared or contracted. Comparisons first take small parity sketches, which bound the difference of two sets from
below, so only pairs that may link move on to be verified. No bucket is capped and no component is split, but links
inside a component are not all found: ``similar`` and what builds on it give components only. ``links`` and ``linked``
give every link between different texts and their number; they compare all pairs of a bucket, without contraction,
and their pairs are as many as the links, which grow with the square of a group's size.

Defined results: null, empty and blank texts have empty sets and link with nothing, not even with each other; equal
texts always share a component; repeated rows are separate rows; a null id never is a component's least id unless
there is no other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, drop, fresh, map_arrow, release, table, text_key
from .components import components
from .hashing import BASE, U, exact_sets, mix, runs, shingle_counts, shingle_sets
from .texts import distinct_texts, small


CENTRES = 4096  # of a bucket in a round, at most
MARKS = 1 << 25  # bits that tell which signatures may occur twice
SALT = 1024  # members of a bucket that one task compares


class PartEnum:
    """Signatures for Jaccard similarity of percent / 100 or more."""

    def __init__(self, percent: int):
        assert 67 <= percent <= 100, "a partner's size must lie in the same band or the next"
        self.percent = percent
        self.ratio = (5, 4) if percent >= 80 else (3, 2)  # of a band's largest size to its least
        self.slack = 5 if percent < 85 else 10  # one spare partition for so many

    def band(self, size: int) -> tuple[int, int, int]:
        """Number, least and largest size of the band of a set size."""
        num, den = self.ratio
        t, low = 0, 1
        while size > max(low, low * num // den):
            t, low = t + 1, max(low, low * num // den) + 1
        return t, low, max(low, low * num // den)

    def plan(self, most: int) -> tuple[int, int, int, int]:
        """n1, spare, n2, k2 for sets of at most so many elements: any two that link differ in at most K elements.

        Of n1 + spare partitions, at least 1 + spare have at most k2 different parts.
        """
        differ = 2 * most * (100 - self.percent) // (100 + self.percent)
        if not differ:
            return 1, 0, 1, 0
        n1 = differ // 2 + 1
        return n1, -(-n1 // self.slack), 3 if differ < 8 else 2, 1

    def tags(self, size: int) -> list[tuple[int, int]]:
        """(band, largest size) of the bands in which a set of that size has signatures: its own, and the next if a partner may be there."""
        t, _, top = self.band(size)
        return [(t, top)] + ([(t + 1, self.band(top + 1)[2])] if size * 100 >= self.percent * (top + 1) else [])

    def signatures(self, x: np.ndarray) -> np.ndarray:
        """All signatures of a set of hashes.

        What an empty part says is shared by unrelated sets. A set that has such signatures in no more partitions than
        there are spare ones leaves them out: in one of the partitions where it agrees with a partner, it has none.
        """
        out = []
        for t, most in self.tags(len(x)):
            n1, spare, n2, k2 = self.plan(most)
            n = n1 + spare
            y = mix(x + U((t + 1) * BASE % 2**64))
            part = ((y >> U(33)) % U(n * n2)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(y[order]))])
            ends = np.searchsorted(part[order], np.arange(n * n2 + 1))
            held, size = (sums[ends[1:]] - sums[ends[:-1]]).reshape(n, n2), np.diff(ends).reshape(n, n2)
            seed = mix(np.arange(n, dtype=U) + U(t << 32))
            subsets = [list(kept) for kept in combinations(range(n2), n2 - k2)]
            signs = np.array([mix(held[:, kept].sum(axis=1, dtype=U) * U(BASE) + seed + U(i)) for i, kept in enumerate(subsets)])
            empty = np.array([size[:, kept].sum(axis=1) == 0 for kept in subsets])
            out.append(signs[~empty] if empty.any(axis=0).sum() <= spare else signs.ravel())
        return np.concatenate(out)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column("text").cast(pa.large_binary())]


def _signer(words: int, percent: int, marks: np.ndarray | None = None):
    """Rows (tid, text) to (sig, tid); with marks only the signatures whose bit is set."""

    def run(batches):
        p = PartEnum(percent)
        for b in batches:
            tids, sigs = [], []
            for tid, x in zip(b.column("tid").to_pylist(), shingle_sets(_texts(b), words), strict=True):
                if len(x):
                    s = p.signatures(x)
                    if marks is not None:
                        at = s & U(MARKS - 1)
                        s = s[(marks[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1) == 1]
                    sigs.append(s)
                    tids.append(np.full(len(s), tid, np.int64))
            if tids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(tids))], ["sig", "tid"])

    return run


def sketch(x: np.ndarray, wide: int = 1) -> bytes:
    """Parities of a set's elements over 2^j >= wide * n buckets: two sets differ in at least as many elements as their sketches in bits."""
    bits = max(512, 1 << (wide * len(x) - 1).bit_length())
    odd = np.bincount((x >> U(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def most_apart(sizes: np.ndarray, percent: int) -> np.ndarray:
    """In how many elements two sets may differ that link, by the sum of their sizes."""
    return sizes - 2 * -(-sizes * percent // (100 + percent))


def _fold(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches as rows of 64-bit words, folded to one size."""
    out = np.empty((len(sketches), size // 8), U)
    for i, s in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(s, U).reshape(-1, size // 8), axis=0)
    return out


def _sketches(words: int, wide: int = 1):
    """Rows (tid, text) to (tid, n, sk): number and sketch of the shingles' hashes."""

    def run(batches):
        for b in batches:
            sets = shingle_sets(_texts(b), words)
            yield pa.RecordBatch.from_arrays([b.column("tid"), pa.array([len(x) for x in sets], pa.int64()), pa.array([sketch(x, wide) for x in sets], pa.binary())], ["tid", "n", "sk"])

    return run


def _counts(words: int):
    """Rows (tid, text) to (tid, n): how many shingles."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("tid"), pa.array(shingle_counts(_texts(b), words))], ["tid", "n"])

    return run


def _verifier(words: int, percent: int):
    """Rows (u, v, tu, tv) to those (u, v) whose texts link by their words."""

    def run(batches):
        for b in batches:
            sides = [[x.as_buffer() for x in b.column(c).cast(pa.large_binary())] for c in ("tu", "tv")]
            for i, j in runs([x.size + y.size for x, y in zip(*sides, strict=True)], 1 << 22):
                part = b.slice(i, j - i)
                ids = part.column("u").to_pylist() + part.column("v").to_pylist()
                texts = dict(zip(ids, sides[0][i:j] + sides[1][i:j], strict=True))
                sets = dict(zip(texts, exact_sets([x.to_pybytes() for x in texts.values()], words), strict=True))
                keep = []
                for u, v in zip(ids[: j - i], ids[j - i :], strict=True):
                    both = len(np.intersect1d(sets[u], sets[v], assume_unique=True))
                    keep.append(both * 100 >= (len(sets[u]) + len(sets[v]) - both) * percent)
                yield part.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _may_link(percent: int):
    """Rows (u, v, nu, nv, su, sv) to those (u, v) that the sketches don't rule out."""

    def run(batches):
        for b in batches:
            n = b.column("nu").to_numpy() + b.column("nv").to_numpy()
            keep = [
                int(np.bitwise_count(np.bitwise_xor(*_fold([x, y], min(len(x), len(y))))).sum()) <= most
                for x, y, most in zip(b.column("su").to_pylist(), b.column("sv").to_pylist(), most_apart(n, percent).tolist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _compared(percent: int):
    """Rows (sig, salt, kind, rank, tid, root, n, sk), centres (kind 0) before members, to pairs (u, v) across roots that the sketches don't rule out."""

    def run(batches):
        at, centres = None, []
        for b in batches:
            found = [], []
            keys = list(zip(b.column("sig").to_pylist(), b.column("salt").to_pylist(), strict=True))
            kind = b.column("kind").to_pylist()
            i = 0
            while i < len(keys):
                if keys[i] != at:
                    at, centres, ready = keys[i], [], None
                j = i
                while j < len(keys) and keys[j] == at and kind[j] == kind[i]:
                    j += 1
                part = b.slice(i, j - i)
                rank, tid, root, n = (part.column(c).to_numpy() for c in ("rank", "tid", "root", "n"))
                if kind[i] == 0:
                    centres.append((rank, tid, root, n, part.column("sk").to_pylist()))
                elif centres:
                    if len(centres) > 1 or ready is None:
                        centres = [tuple(np.concatenate([c[k] for c in centres]) for k in range(4)) + ([s for c in centres for s in c[4]],)]
                    crank, ctid, croot, cn, csk = centres[0]
                    sk = part.column("sk").to_pylist()
                    size = min(map(len, sk + csk))
                    if ready is None or ready.shape[1] != size // 8:
                        ready = _fold(csk, size)
                    for k, one in enumerate(_fold(sk, size)):
                        other = (crank < rank[k]) & (croot != root[k])
                        near = other & (np.minimum(cn, n[k]) * 100 >= np.maximum(cn, n[k]) * percent)
                        c = np.flatnonzero(near)
                        c = c[np.bitwise_count(ready[c] ^ one).sum(axis=1) <= most_apart(cn[c] + n[k], percent)]
                        found[0].append(ctid[c])
                        found[1].append(np.full(len(c), tid[k]))
                i = j
            if found[0]:
                x, y = (np.concatenate(f) for f in found)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["u", "v"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those pairs (u, v) whose texts link."""
    u, v = (texts.select(F.col("tid").alias(x), F.col("text").alias(f"t{x}")) for x in "uv")
    return map_arrow(pairs.join(v, "v").join(u, "u").select("u", "v", "tu", "tv"), _verifier(words, percent), "u long, v long")


def _paired(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Those pairs (u, v) that neither sizes nor sketches rule out."""
    u, v = (sketches.select(F.col("tid").alias(x), F.col("n").alias(f"n{x}"), F.col("sk").alias(f"s{x}")) for x in "uv")
    pairs = pairs.join(v, "v").join(u, "u").where(F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent)
    return map_arrow(pairs.select("u", "v", "nu", "nv", "su", "sv"), _may_link(percent), "u long, v long")


def _marks(sigs: DataFrame) -> np.ndarray:
    """A bitmap of fixed size (MARKS bits) with the low bits of all signatures set."""
    at = F.col("sig").bitwiseAND(F.lit(MARKS - 1))
    words = sigs.groupBy(F.shiftright(at, 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(sig & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(MARKS // 64, U)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(U)
    return out


def _links(texts: DataFrame, words: int, percent: int, every: bool = False) -> tuple[DataFrame, str]:
    """(node, root) of the texts that link with another; with every, all links (u, v), u < v, once each."""
    spark = texts.sparkSession
    # signatures are made anew for each use: cheaper in disk than to keep. The second time a bitmap of fixed size rules
    # out most that occur once; the join that follows is exact however full it is.
    sign = lambda marks: map_arrow(texts.select("tid", "text"), _signer(words, percent, marks), "sig long, tid long")
    often, often_path = table(sign(None).groupBy("sig").agg(F.count("*").alias("size")).where("size > 1").select("sig"), "often")
    release(spark)
    buckets, buckets_path = table(sign(_marks(often)).join(small(often), "sig"), "buckets")
    release(spark)
    # buckets of the same members ask for the same comparisons
    alike = buckets.groupBy("sig").agg(F.count("*").alias("size"), F.sum(F.xxhash64("tid") % (1 << 31)).alias("a"), F.expr("bit_xor(xxhash64(tid, 1))").alias("b"), F.expr("bit_xor(xxhash64(tid, 2))").alias("c"))
    one, one_path = table(alike.groupBy("size", "a", "b", "c").agg(F.min("sig").alias("sig")).select("sig"), "one")
    kept, kept_path = table(buckets.join(small(one), "sig"), "kept")
    # the more buckets a text shares, the nearer it is to the middle of its kind
    members, members_path = table(buckets.groupBy("tid").agg(F.count("*").alias("company")), "members")
    own = texts.select("tid", "text").join(small(members), "tid")
    sketches, sketches_path = table(map_arrow(own.select("tid", "text"), _sketches(words), "tid long, n long, sk binary"), "sketches")
    # of what is joined by bucket, one side is a written aggregate: the other is a plain shuffle, and a bucket can be split
    near, near_path = table(kept.join(members, "tid").select("sig", "tid", "company"), "company")
    best, best_path = table(near.groupBy("sig").agg(F.max(F.struct("company", "tid"))["tid"].alias("u"), F.count("*").alias("size")), "best")
    near, both_path = table(near.join(best, "sig").withColumn("salt", F.expr(f"pmod(xxhash64(tid), size div {SALT} + 1)")), "salted")
    # the centre has rank 0; members are ranked within salts, and salts take turns: ranks are unique, with gaps
    rank = F.when(F.col("tid") == F.col("u"), 0).otherwise(F.expr(f"(row_number() over (partition by sig, salt order by company desc, tid desc) - 1) * (size div {SALT} + 1) + salt + 1"))
    ranked, ranked_path = table(near.withColumn("rank", rank.cast("long")).select("sig", "tid", "u", "size", "rank"), "ranked")
    drop(spark, often_path, buckets_path, one_path, kept_path, members_path, near_path, best_path, both_path)
    release(spark)

    pairs = ranked.where("rank > 0").select("u", F.col("tid").alias("v")).distinct()
    pairs, pairs_path = table(_paired(pairs, sketches, percent), "pairs")

    def links_of(pairs: DataFrame) -> tuple[DataFrame, str]:
        who = pairs.select(F.col("u").alias("tid")).unionByName(pairs.select(F.col("v").alias("tid"))).distinct()
        who, who_path = table(who, "who")
        own = texts.select("tid", "text").join(small(who), "tid")
        sets, sets_path = table(map_arrow(own, _sketches(words, 4), "tid long, n long, sk binary"), "sets")
        near, near_path = table(_paired(pairs, sets, percent), "near")
        out = table(_verified(near, own, words, percent), "verified")
        drop(spark, who_path, sets_path, near_path)
        release(spark)
        return out

    links, links_path = links_of(pairs)
    drop(spark, pairs_path)
    roots, roots_path = (None, None) if every else components(links)
    done, centres = 0, 64
    while True:
        if every:  # each text is a component of its own, so all pairs are compared
            at = ranked.select("sig", "tid", "size", "rank", F.col("tid").alias("root"))
        else:
            at = ranked.join(roots, ranked["tid"] == roots["node"], "left").select("sig", "tid", "size", "rank", F.coalesce("root", "tid").alias("root"))
        spans = at.groupBy("sig").agg(F.min("root").alias("a"), F.max("root").alias("z"), F.max("rank").alias("last")).where((F.col("a") != F.col("z")) & (F.col("last") > done)).select("sig")
        spans, spans_path = table(spans, "spans")
        split, split_path = table(at.where(F.col("rank") > done).join(spans, "sig"), "split")
        if split.isEmpty():
            drop(spark, split_path, spans_path)
            break
        full = split.join(sketches, "tid")
        rows = full.where(F.col("rank") <= done + centres).select("sig", F.explode(F.expr(f"sequence(0L, size div {SALT})")).alias("salt"), F.lit(0).alias("kind"), "rank", "tid", "root", "n", "sk")
        rows = rows.unionByName(full.select("sig", F.expr(f"pmod(rank, size div {SALT} + 1)").alias("salt"), F.lit(1).alias("kind"), "rank", "tid", "root", "n", "sk"))
        rows = rows.repartition("sig", "salt").sortWithinPartitions("sig", "salt", "kind", "rank")
        pairs, pairs_path = table(map_arrow(rows, _compared(percent), "u long, v long").distinct(), "pairs")
        drop(spark, split_path, spans_path)
        done, centres = done + centres, min(centres * 8, CENTRES)
        if pairs.isEmpty():
            drop(spark, pairs_path)
            continue
        more, more_path = links_of(pairs)
        both, both_path = table(links.unionByName(more), "verified")
        drop(spark, pairs_path, more_path, links_path)
        links, links_path = both, both_path
        if not every:
            drop(spark, roots_path)
            roots, roots_path = components(links)
    if every:
        roots, roots_path = table(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    drop(spark, links_path, ranked_path, sketches_path)
    return roots, roots_path


def similar(docs: DataFrame, words: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (of the text), n_shingles, component_id (least id reachable by links), component for every row of docs.

    component tells components apart even where ids are null or repeated; it is null for empty sets.
    """
    spark = docs.sparkSession
    texts, texts_path, rows, _ = distinct_texts(docs, id_col, text_col)
    sizes, sizes_path = table(map_arrow(texts.select("tid", "text"), _counts(words), "tid long, n long"), "sizes")
    roots, roots_path = _links(texts, words, percent)
    slim = texts.select("tid", "key", "least_id").join(sizes, "tid").join(roots, F.col("tid") == F.col("node"), "left")
    slim, slim_path = table(slim.select("key", "least_id", "n", F.coalesce("root", "tid").alias("root")), "slim")
    # written, so that a component of very many texts can be split
    least, least_path = table(slim.groupBy("root").agg(F.min("least_id").alias("component")), "least")
    by_key = slim.join(least, "root").groupBy("key").agg(F.max("n").alias("n_shingles"), F.min("component").alias("least"), F.min("root").alias("root"))
    by_key, _ = table(by_key, "classes")
    drop(spark, texts_path, sizes_path, roots_path, slim_path, least_path)
    some = F.col("n_shingles") > 0
    return rows.join(by_key, "key").select("doc_id", "key", "n_shingles", F.when(some, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"), F.when(some, F.col("root")).alias("component"))


def _linked(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(key_a, key_b) of every link between different texts, written."""
    found, found_path = _links(texts, words, percent, every=True)
    a, b = (texts.select(F.col("tid").alias(t), F.col("key").alias(k)) for t, k in (("u", "a"), ("v", "b")))
    # a text may have several tids
    keys = found.join(a, "u").join(b, "v").where("a <> b").select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b")).distinct()
    out, _ = table(keys, "text-links")
    drop(texts.sparkSession, found_path)
    return out


def links(docs: DataFrame, words: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key_a, key_b (digests of the texts, key_a < key_b): every verified link between different texts, once."""
    texts, texts_path, _, rows_path = distinct_texts(docs, id_col, text_col)
    out = _linked(texts, words, percent)
    drop(docs.sparkSession, texts_path, rows_path)
    return out


def linked(docs: DataFrame, words: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, n_links (other texts that the row's text links with) for every row of docs; 0 for empty sets."""
    texts, texts_path, rows, _ = distinct_texts(docs, id_col, text_col)
    pairs = _linked(texts, words, percent)
    drop(docs.sparkSession, texts_path)
    ends = pairs.select(F.col("key_a").alias("key")).unionByName(pairs.select(F.col("key_b").alias("key")))
    n = ends.groupBy("key").agg(F.count("*").alias("n_links"))
    return rows.join(n, "key", "left").select("doc_id", "key", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the least non-null id (then the least text digest). Rows with empty sets stay."""
    found, _ = table(similar(docs, words, percent, id_col, text_col), "similar")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    first, first_path = table(found.where("component is not null").groupBy("component").agg(F.min(rank).alias("first")).select("component", F.col("first.doc_id").alias("first_id"), F.col("first.key").alias("first_key")), "first")
    groups, groups_path = table(found.where("component is not null").groupBy("component", "doc_id", "key").agg(F.count("*").alias("n")), "groups")
    groups = groups.join(small(first), "component")
    same = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("key") == F.col("first_key"))
    # what goes, and what stays but once: few rows beside those that stay as they are
    i, k, stays = fresh(docs, "_id", "_key", "_stays")
    marked, _ = table(groups.where(~same | (F.col("n") > 1)).select(F.col("doc_id").alias(i), F.col("key").alias(k), same.alias(stays)), "marked")
    drop(docs.sparkSession, first_path, groups_path)
    out = docs.join(small(marked), column(docs, id_col).eqNullSafe(F.col(i)) & (text_key(column(docs, text_col)) == F.col(k)), "left")
    once = out.where(F.col(stays)).dropDuplicates([i, k])
    return out.where(F.col(k).isNull()).unionByName(once).drop(i, k, stays)


def report(docs: DataFrame, **options) -> DataFrame:
    return similar(docs, **options).select("doc_id", "n_shingles", "component_id")
