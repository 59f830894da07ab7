"""Corpus pipeline: documents to shards.

Language ID drops documents without a recognised language, the Jaccard join keeps one document of each group of near
duplicates (five words, 0.8), decontamination drops documents that hold benchmark text, mixing repeats or leaves out
documents towards the sources' targets, and sharding places what is left. Each stage works on all rows that the one
before kept and handles nulls, empty and long texts, repeated rows and empty tables as its operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessel.llm import decontaminate, jaccard, langid, mixing, sharding
from tessel.llm.common import drop, scratch, table

#: Language ID has no SQL.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language."""
    return langid.recognised(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.keep_one(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark text."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.minimax_shards(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("shards", shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each result is written and reread, and all else that a stage wrote is deleted then."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch(spark) as made:
            docs, path = table(stage(spark, docs, sf_dir), f"pipeline-{name}", "snappy")
            made.remove(path)
        if before:
            drop(spark, before)
        before = path
    return docs
