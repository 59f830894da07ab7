"""Connected components of links, by alternating large and small stars; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, release, table


def components(links: DataFrame) -> tuple[DataFrame, str]:
    """(node, root) of every node of links (u, v): root is the least node of its component. Written, with its path.

    Least neighbours are written before they meet their node's links again, so both sides of each join are plain
    shuffles and a node with very many links can be split among tasks.
    """
    spark = links.sparkSession
    e, path = table(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, least_path = table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large, large_path = table(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        drop(spark, path, least_path)
        least, least_path = table(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new, new_path = table(small, "links")
        now = new.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(pmod(xxhash64(v, u), 1000003) as long))")).first()
        drop(spark, large_path, least_path)
        e, path = new, new_path
        if now == mark or not now[0]:
            break
        mark = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
    out, out_path = table(nodes, "components")
    drop(spark, path)
    release(spark)
    return out, out_path
