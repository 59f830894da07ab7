"""Benchmark decontamination (DataFrame functions only).

Windows of the benchmark's words form a broadcast hash set, in blocks of a bounded number of entries; documents are read
once for each block. An entry is the digest of a window's first, middle and last word and its length: every place of a
document is looked up by those, which streams through one stage without a shuffle, and the few places that hit are
compared by all their words, so neither the digest nor a collision changes anything.

Defined results: a null or wordless text has no words, no hits and isn't contaminated; an item without words is
ignored; an item shorter than a window is one window of all its words; equal item ids count once; items with a null
id mark words but aren't listed; repeated documents are separate rows; without items nothing is contaminated; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, column, drop, fresh, table, text_key
from .texts import small

#: A word is a run of digits, letters a-z and all beyond ASCII.
BETWEEN = "".join(chr(i) for i in range(128) if not (chr(i).isdigit() or chr(i).isalpha()))
SET_ROWS = 1 << 20  # of the hash set that travel at once: 16 to 32 MB


def words(text: Column) -> Column:
    """The words in order, A-Z lower-cased: what separates them becomes blanks, which is far cheaper than a pattern's matches."""
    plain = F.translate(text, UPPER + BETWEEN, UPPER.lower() + " " * len(BETWEEN))
    return F.coalesce(F.array_remove(F.split(plain, " "), ""), F.array().cast("array<string>"))


def windows(benchmark: DataFrame, size: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item_id, length, win, ends): an item's windows as words joined by blanks, and the digest of three of them."""
    w = benchmark.select(column(benchmark, id_col).cast("string").alias("item_id"), words(column(benchmark, text_col)).alias("w")).where(F.size("w") > 0)
    at = F.expr(f"explode(sequence(1, greatest(size(w) - {size - 1}, 1)))")
    one = w.select("item_id", "w", at.alias("at")).select("item_id", F.expr(f"slice(w, at, least({size}, size(w)))").alias("win")).withColumn("length", F.size("win"))
    ends = _ends(*(F.xxhash64(F.get("win", i)) for i in (F.lit(0), F.floor(F.col("length") / 2).cast("int"), F.col("length") - 1)), F.col("length"))
    return one.select("item_id", "length", F.array_join("win", " ").alias("win"), ends.alias("ends")).distinct()


def _ends(first: Column, middle: Column, last: Column, length: Column) -> Column:
    return F.xxhash64(first, middle, last, length.cast("int"))


def hits(docs: DataFrame, ends: DataFrame, lengths: list[int], id_col: str, text_col: str, rows: bool) -> DataFrame:
    """Places whose ends are in the set: (doc_id, key of the text, n_words, at from 1, length, win); with rows also one for each document, at null."""
    base = docs.select(column(docs, id_col).alias("doc_id"), text_key(column(docs, text_col)).alias("key"), words(column(docs, text_col)).alias("ws"))
    base = base.withColumn("hs", F.transform("ws", lambda x: F.xxhash64(x)))
    # one place more than there are words stands for the document; the outer form keeps the array from being made twice
    each = base.select("doc_id", "key", "ws", "hs", F.posexplode_outer(F.array_append("hs", F.lit(None).cast("long"))).alias("at", "h"))
    each = each.withColumn("length", F.explode_outer(F.array(*map(F.lit, lengths)))) if len(lengths) > 1 else each.withColumn("length", F.lit(lengths[0]))
    n = F.size("hs")
    inside = F.col("at") + F.col("length") <= n
    digest = _ends(F.col("h"), F.get("hs", F.col("at") + F.floor(F.col("length") / 2).cast("int")), F.get("hs", F.col("at") + F.col("length") - 1), F.col("length"))
    each = each.withColumn("ends", F.when(inside, digest))
    found = each.join(F.broadcast(ends.select(F.col("ends").alias("hit"))), F.col("ends") == F.col("hit"), "left")
    is_hit = F.col("hit").isNotNull()
    found = found.where(is_hit | ((F.col("at") == n) & (F.col("length") == lengths[0]) & F.lit(rows)))
    win = F.array_join(F.slice("ws", F.col("at") + 1, F.col("length")), " ")
    return found.select("doc_id", "key", n.cast("long").alias("n_words"), F.when(is_hit, F.col("at") + 1).alias("at"), F.when(is_hit, F.col("length")).alias("length"), F.when(is_hit, win).alias("win"))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", percent: int = 5, set_rows: int = SET_ROWS) -> DataFrame:
    """doc_id, key (of the text), n_words, spans (word ranges from 1, inclusive), n_hit, items, contaminated for every document.

    Contaminated: at least ``percent`` of the words lie in windows that a benchmark item holds too.
    """
    spark = docs.sparkSession
    grams, grams_path = table(windows(benchmark, size, item_col, text_col), "decon-grams")
    ends, ends_path = table(grams.select("ends").distinct(), "decon-ends")
    lengths = sorted(r[0] for r in grams.select("length").distinct().collect()) or [size]  # as many as a window has words, at most
    blocks = max(1, -(-ends.count() // set_rows))
    done = [table(hits(docs, ends.where(F.pmod("ends", F.lit(blocks)) == i), lengths, id_col, text_col, rows=i == 0), "decon-hits") for i in range(blocks)]
    # equal texts have equal hits: those of a text are worked on once
    found = done[0][0]
    for more, _ in done[1:]:
        found = found.unionByName(more)
    found = found.where("at is not null").select("key", "at", "length", "win").distinct()
    found = found.join(small(grams.select("win", "item_id")), "win").groupBy("key").agg(
        F.array_sort(F.collect_set(F.struct("at", (F.col("at") + F.col("length") - 1).alias("to")))).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items")
    )
    n_hit = F.expr("aggregate(spans, named_struct('n', 0L, 'last', 0), (s, x) -> named_struct('n', s.n + greatest(0, x.to - greatest(s.last, x.at - 1)), 'last', greatest(s.last, x.to)), s -> s.n)")
    found, _ = table(found.select(F.col("key").alias("hit"), "spans", "items", n_hit.alias("n_hit")), "decon-found")
    drop(spark, grams_path, ends_path, *[path for _, path in done[1:]])
    rows = done[0][0].where("at is null").select("doc_id", "key", "n_words")
    out = rows.join(found, F.col("key") == F.col("hit"), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "key", "n_words", F.coalesce("spans", F.expr("cast(array() as array<struct<at:int,to:int>>)")).alias("spans"), n_hit.alias("n_hit"), items.alias("items"), ((n_hit > 0) & (100 * n_hit >= percent * F.col("n_words"))).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs without the contaminated ones."""
    (k,) = fresh(docs, "_key")
    found = contamination(docs, benchmark, text_col=text_col, **options).where("contaminated").select(F.col("key").alias(k)).distinct()
    found, _ = table(found, "contaminated")
    return docs.join(small(found), text_key(column(docs, text_col)) == F.col(k), "left_anti")


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    c = contamination(docs, benchmark, **options)
    return c.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
