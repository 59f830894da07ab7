import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tessel.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, size=13):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            v = words(text)
            n = min(size, len(v))
            grams = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)} if v else set()
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in grams:
                    hit |= set(range(j, j + n))
                    found.add(item)
        names = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.fixture
def case(spark):
    rng = random.Random(3)
    vocabulary = ["a", "b", "Ä", "é9", "the", "x"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(10, text(20)), (9, text(13)), (2, "One, two; THREE"), (3, None), (4, "..."), (9, text(15)), (None, text(16)), (5, "solo")]
    docs = [(i, text(rng.randrange(60))) for i in range(60)]
    docs += [(100, text(30) + " " + items[0][1] + " " + text(9)), (100, items[1][1].upper() + "!"), (101, "so one-two three."), (102, None), (None, ""), (103, "w " * 5000 + items[0][1]), (104, items[6][1]), (105, "SOLO"), (106, "one two")]
    return docs, items, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("limit", [decontaminate.SET_ROWS, 7])
def test_against_brute_force(documents, rows, case, limit):
    docs, items, benchmark = case
    assert rows(decontaminate.report(documents(*docs), benchmark, set_rows=limit)) == brute(docs, items)


def test_words(spark):
    every = "".join(map(chr, range(300)))
    texts = [every, every[::-1], "", " ", "a", "\x00a\x00\x00B\x7f", "Äß9z  É", None, "  lead, trail  ", "İK"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(decontaminate.words(F.col("t"))).collect()
    assert [r[0] for r in got] == [words(t) for t in texts]


def test_large_benchmark(spark, documents, rows):
    """More than 50,000 windows, in several blocks of the one path."""
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(60)) for _ in range(n))
    items = [(i, text(5_300)) for i in range(10)]
    docs = [(i, f"{text(20)} {' '.join(items[i % 10][1].split()[i * 40 : i * 40 + 12 + i % 3])} {text(20)}") for i in range(60)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.windows(benchmark, 13).count() > 50_000
    got = rows(decontaminate.report(documents(*docs), benchmark, set_rows=20_000))
    grams = {}
    for i, t in items:
        v = words(t)
        for j in range(len(v) - 12):
            grams.setdefault(tuple(v[j : j + 13]), set()).add(str(i))
    want = []
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for j in range(len(w) - 12):
            if tuple(w[j : j + 13]) in grams:
                hit |= set(range(j, j + 13))
                names |= grams[tuple(w[j : j + 13])]
        want.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    assert got == sorted(want, key=repr) and sum(x[2] > 0 for x in want) >= 40


def test_spans_and_clean(documents, rows, case):
    docs, items, benchmark = case
    df = documents(*docs)
    found = decontaminate.contamination(df, benchmark)
    for r in found.collect():
        covered = {p for s in r["spans"] for p in range(s["at"], s["to"] + 1)}
        assert len(covered) == r["n_hit"]
    bad = {b[0] for b in brute(docs, items) if b[5]}
    clean = decontaminate.clean(df, benchmark)
    assert clean.columns == df.columns
    assert sorted(map(repr, (r["doc_id"] for r in clean.collect()))) == sorted(repr(b[0]) for b in brute(docs, items) if not b[5])
    assert bad


def test_empty(documents, rows, case, spark):
    docs, items, benchmark = case
    assert rows(decontaminate.report(documents(*docs).where("false"), benchmark)) == []
    assert rows(decontaminate.report(documents((1, "a b")), benchmark.where("false"))) == [(1, 2, 0, 0, hashlib.sha256(b"").hexdigest(), False)]
