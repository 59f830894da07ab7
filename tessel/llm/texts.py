"""Each distinct text once, and which rows hold it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

from .common import column, drop, table, text_key

BROADCAST_BYTES = 8 << 20


def _bytes(name: str, kind) -> Column:
    """About how many bytes a value takes."""
    c = F.col("`" + name.replace("`", "``") + "`")
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0))
    assert not isinstance(kind, (ArrayType, MapType, StructType)), "only flat rows are broadcast"
    return F.lit(8)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if its rows take at most so many bytes, counting 32 for each beside its values. Of more rows than that allows none are read."""
    width = sum((_bytes(f.name, f.dataType) for f in df.schema), F.lit(32))
    taken = df.select(width.cast("long").alias("b")).limit(most // 32 + 1).agg(F.sum("b")).first()[0] or 0
    return F.broadcast(df) if taken <= most else df


def distinct_texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, DataFrame, str]:
    """(tid, key, text, n_rows, least_id) for every text, written; (doc_id, key) of every row, written; with their paths.

    Only digests are grouped; texts move to the written table straight from the scan. Rows that agree in id and text
    may give a text more than one tid. A null text has the key of the empty one.
    """
    text, id_ = column(docs, text_col), column(docs, id_col)
    rows, rows_path = table(docs.select(id_.alias("doc_id"), text_key(text).alias("key")), "rows")
    again, again_path = table(rows.groupBy("key").agg(F.count("*").alias("n_rows"), F.min("doc_id").alias("least_id")).where("n_rows > 1"), "again")
    full = docs.select(id_.alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), text_key(text).alias("key"))
    kept = full.join(small(again), "key", "left").where(F.col("n_rows").isNull() | F.col("doc_id").eqNullSafe(F.col("least_id")))
    kept = kept.select(F.monotonically_increasing_id().alias("tid"), "key", "text", F.coalesce("n_rows", F.lit(1)).alias("n_rows"), F.coalesce("least_id", "doc_id").alias("least_id"))
    texts, texts_path = table(kept, "texts")
    drop(docs.sparkSession, again_path)
    return texts, texts_path, rows, rows_path
