"""Mixing sources to target weights by systematic sampling.

Sources get targets by capped proportional sharing; each document's expected copies are target / source size, the
same within a source, so their prefix sum is a rank times that ratio. One offset for each source is added, and a
document is emitted once for every integer crossed. Ranks are taken within (source, size class, slice of a digest of
the id), whose counts are summed in two small steps, so no source, however large, has to meet in one task. Ordering
by size class first keeps the words taken near the target.

Defined results: a null text has size 0; null is a source of its own, after all others; a source without words has
target 0 and takes nothing; repeated rows are separate rows; equal ids and sizes tie, and which of the equal rows is
taken is then indifferent; an empty table gives no rows; extra columns are kept by ``mix`` unless the names clash with
its own, which win.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, drop, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
RUN = 1 << 16  # equal rows that are made at once


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, limit: int = 2) -> DataFrame:
    """(skey, source_size, target) of (skey, source_size): ``share`` of all sizes by weight, at most ``limit`` times a source's size.

    Sources are capped in order of limit * size / weight as long as that is at most what the rest would get for each unit of weight.
    """
    order = Window.orderBy("skey")
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.lit(weights[0])
    for i, w in enumerate(weights[1:], 1):
        weight = F.when(turn == i, w).otherwise(weight)
    s = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * limit)
    by = Window.orderBy(F.col("cap") / F.col("weight"), "skey")
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("caps", F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1))).withColumn("used", F.sum("weight").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    budget = F.lit(share) * F.sum("source_size").over(every).cast("double")
    left = (budget - F.coalesce("caps", F.lit(0)).cast("double")) / (F.sum("weight").over(every) - F.coalesce("used", F.lit(0))).cast("double")
    s = s.withColumn("level", left).withColumn("capped", F.col("cap") / F.col("weight") <= F.col("level"))
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "skey", "level"))).over(every)["level"]
    return s.select("skey", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * level).alias("target"))


def _ranked(keyed: DataFrame, weights, share: float, limit: int) -> DataFrame:
    """keyed (size, skey, digest, times: how often a row stands for itself) with source_size, target and rank: of its rows the first's in its source, from 1."""
    bits = F.bin("size")
    keyed = keyed.withColumn("cls", F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.substring(bits, 2, 3))).withColumn("sub", F.substring("digest", 1, 2))
    counts = keyed.groupBy("skey", "cls", "sub").agg(F.sum("times").alias("n"), F.sum(F.col("size") * F.col("times")).alias("words"))
    classes = counts.groupBy("skey", "cls").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))  # a few hundred for each source
    goals = targets(classes.groupBy("skey").agg(F.sum("words").alias("source_size")), weights, share, limit)
    classes = classes.select("skey", "cls", (F.sum("n").over(Window.partitionBy("skey").orderBy("cls")) - F.col("n")).alias("rows_before"))
    subs = counts.select("skey", "cls", "sub", (F.sum("n").over(Window.partitionBy("skey", "cls").orderBy("sub")) - F.col("n")).alias("subs_before"))
    ranks = subs.join(classes, ["skey", "cls"]).join(goals, "skey")
    run = Window.partitionBy("skey", "cls", "sub").orderBy("size", "digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nth = F.sum("times").over(run) - F.col("times") + 1
    return keyed.withColumn("nth", nth).join(ranks, ["skey", "cls", "sub"]).withColumn("rank", F.col("rows_before") + F.col("subs_before") + F.col("nth"))


def _copies(seed: str) -> Column:
    """How many integers the prefix sum of expected copies crosses at a rank."""
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("skey")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(0.0)
    return (F.floor(F.col("rank").cast("double") * ratio + offset) - F.floor((F.col("rank") - 1).cast("double") * ratio + offset)).cast("long")


def _keys(source: Column, id_: Column) -> list[Column]:
    # null last: no other key starts with 1
    return [F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source)).alias("skey"), F.md5(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")).alias("digest")]


OWN = ("size", "source_size", "target", "copies")


def _mix(df: DataFrame, id_col: str, text_col: str, source_col: str, size: Column | None, weights, share: float, limit: int, seed: str) -> DataFrame:
    """(row: df's columns as c0, c1 and so on, size, source_size, target, copies)."""
    size = words(column(df, text_col)) if size is None else size
    row = F.struct(*[column(df, c).alias(f"c{i}") for i, c in enumerate(df.columns)]).alias("row")
    keyed = df.select(row, size.alias("size"), *_keys(column(df, source_col), column(df, id_col)), F.lit(1).alias("times"))
    return _ranked(keyed, weights, share, limit).select("row", "size", "source_size", "target", _copies(seed).alias("copies"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None, weights=WEIGHTS, share: float = 1.5, limit: int = 2, seed: str = "mix") -> DataFrame:
    """df with size, source_size, target and copies: how often the mix takes each document. These take the place of df's columns of these names."""
    m = _mix(df, id_col, text_col, source_col, size, weights, share, limit, seed)
    return m.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(df.columns) if c.lower() not in OWN], *OWN)


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None, weights=WEIGHTS, share: float = 1.5, limit: int = 2, seed: str = "mix") -> DataFrame:
    """df, with all its columns, each row as often as the mix takes it."""
    m = _mix(df, id_col, text_col, source_col, size, weights, share, limit, seed).where("copies > 0")
    return m.select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select("row.*").toDF(*df.columns)


def taken(df: DataFrame, weights=WEIGHTS, share: float = 1.5, limit: int = 2, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target and taken words of every document; the texts are read once."""
    slim, path = table(df.select(column(df, "doc_id").alias("doc_id"), column(df, "source").alias("source"), words(column(df, "text")).alias("size")), "mix")
    equal, _ = table(slim.groupBy("doc_id", "source", "size").agg(F.count("*").alias("times")), "mix-rows")
    drop(df.sparkSession, path)
    m = _ranked(equal.select("doc_id", "size", *_keys(F.col("source"), F.col("doc_id")), "times"), weights, share, limit)
    m = m.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(RUN).cast("long"))))
    m = m.withColumn("at", F.explode(F.sequence("at", F.least(F.col("at") + RUN, "times") - 1))).withColumn("rank", F.col("rank") + F.col("at"))
    return m.select("doc_id", "size", "source_size", "target", (_copies(seed) * F.col("size")).alias("taken"))
