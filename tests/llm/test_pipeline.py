"""The pipeline against plain Python, stage by stage, and over odd inputs."""

import random

import corpus_pipeline
import pytest
from test_decontaminate import brute as contaminated
from test_jaccard import brute as similar

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1):
    rng = random.Random(seed)
    syllables = {"xa": ["ka", "to", "mi", "ren"], "yo": ["äl", "ör", "ung", "sch"]}
    rows = []

    def text(lang, n):
        return " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(n))

    items = [(i, text("xa", 20)) for i in range(5)]
    for i in range(160):
        lang = rng.choice(sorted(syllables))
        t = text(lang, rng.randrange(8, 60))
        if i % 8 == 0 and rows:
            words = rows[-1][1].split()
            words[rng.randrange(len(words))] = "changed"
            t = " ".join(words)
        if i % 20 == 5:
            t += " " + items[i % 5][1]
        rows.append((i, t, lang, rng.choice(["a", "b", "c", None]), len(t)))
    rows += [(900, None, None, None, None), (901, "", "xa", "a", 0), (902, "12 34 56", "xa", "a", 8), (903, rows[0][1], "xa", "a", 1), (903, rows[0][1], "xa", "a", 1)]
    return rows, items


@pytest.fixture
def folder(spark, tmp_path):
    rows, items = corpus()
    path = f"file://{tmp_path}"
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_against_plain_python(spark, folder):
    rows, items = corpus()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["language", "near_duplicates", "decontamination", "mixture", "shards"]

    out = stage["language"](spark, docs, folder)
    assert out.columns == docs.columns
    want = [r for r in rows if r[0] not in (900, 901, 902)]
    assert sorted(tuple(r) for r in out.collect()) == sorted(want, key=lambda r: r[0])

    out = stage["near_duplicates"](spark, spark.createDataFrame(want, DOCUMENTS), folder)
    assert out.columns == docs.columns
    first = {c for *_, c in similar([r[:2] for r in want], 5, 80)}
    want = [r for r in want if r[0] in first]
    assert len(want) < 160 and sorted(r["doc_id"] for r in out.collect()) == sorted(r[0] for r in want)

    out = stage["decontamination"](spark, spark.createDataFrame(want, DOCUMENTS), folder)
    assert out.columns == docs.columns
    bad = {r[0] for r in contaminated([r[:2] for r in want], items) if r[5]}
    want = [r for r in want if r[0] not in bad]
    assert bad and sorted(r["doc_id"] for r in out.collect()) == sorted(r[0] for r in want)

    out = stage["mixture"](spark, spark.createDataFrame(want, DOCUMENTS), folder)
    assert out.columns == docs.columns
    mixed = [tuple(r) for r in out.collect()]
    words = lambda rs: sum(len(r[1].split()) for r in rs)
    assert set(mixed) <= set(want) and max(map(mixed.count, mixed)) <= 2 and abs(words(mixed) / words(want) - 1.5) < 0.1

    out = stage["shards"](spark, spark.createDataFrame(mixed, DOCUMENTS), folder).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(r[0] for r in mixed)
    assert max(r["shard"] for r in out) <= 23


def test_run(spark, folder):
    first, again = (sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=repr) for _ in range(2))
    assert first == again and len(first) > 100


def test_empty(spark, folder, tmp_path):
    other = f"file://{tmp_path}/none"
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(f"{other}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{other}/benchmark.parquet")
    assert corpus_pipeline.run(spark, other).collect() == []


CLASHING = ("_id", "_key", "_stays", "_copy", "copy", "row", "c0", "size", "SIZE", "rank", "digest", "times", "cls", "sub", "nth", "copies", "target", "source_size", "key", "tid", "a.b")


def test_every_column_stays(spark, folder):
    """Whatever the names of further columns are, all stages but the last return them as they were."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    case = spark.conf.get("spark.sql.caseSensitive")
    docs = docs.select("*", *[docs["doc_id"].cast("string").alias(c) for c in CLASHING if c != "SIZE"])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        rows = [tuple(r) for r in out.collect()]
        assert rows and all(x == str(r[0]) for r in rows for x in r[5:] if r[0] is not None), name
        docs = out
    assert spark.conf.get("spark.sql.caseSensitive") == case
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()


def tables(spark):
    from pathlib import Path

    from tessel.llm.common import shared_dir

    return {p.name for p in Path(shared_dir(spark).removeprefix("file://"), "tessel").glob("*")}


def test_a_run_leaves_its_result_only(spark, folder):
    before = tables(spark)
    out = corpus_pipeline.run(spark, folder)
    left = tables(spark) - before
    assert len(left) == 1 and next(iter(left)).startswith("pipeline-shards-") and out.count()
