"""What several operators share: the shared folder, written intermediate tables, text columns."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import map_arrow

__all__ = ["ascii_lower", "column", "drop", "fresh", "map_arrow", "release", "scratch", "shared_dir", "small_batches", "table", "text_key"]
BATCH = 1000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs in one process."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = getattr(spark, "_tessel_dir", None)
    if path is None:
        path = spark._tessel_dir = "file://" + tempfile.mkdtemp(prefix="tessel-")
    return path


@contextmanager
def small_batches(spark: SparkSession):
    """Python gets few rows at once in jobs that are planned meanwhile: whole texts are large rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), BATCH) if int(before) > 0 else BATCH))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(df: DataFrame, label: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """df written as Parquet into the shared folder and reread, and its path: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessel/{label}-{uuid.uuid4().hex}"
    for paths in _open:
        paths.append(path)
    with small_batches(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


#: Paths of the tables written within each ``scratch`` that is open.
_open: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Tables written meanwhile are deleted at its end, but those that are taken out of the list it gives."""
    paths: list[str] = []
    _open.append(paths)
    try:
        yield paths
    finally:
        _open[:] = [p for p in _open if p is not paths]
        drop(spark, *paths)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each made longer until df has no column of it, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def release(spark: SparkSession) -> None:
    """Give memory back, and let Spark delete the shuffle files of frames that are no longer held: it waits for the driver's garbage collector."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark._jvm.System.gc()


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete written intermediate tables through Hadoop's file systems."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(col, UPPER, UPPER.lower())


def text_key(col: Column) -> Column:
    """128 bits of the SHA-256 of the text as 32 hex digits; null counts as empty."""
    return F.substring(F.sha2(F.coalesce(col, F.lit("")), 256), 1, 32)


def column(df: DataFrame, name: str) -> Column:
    """The column of exactly this name, though others may differ from it in case only."""
    return df["`" + name.replace("`", "``") + "`"]
