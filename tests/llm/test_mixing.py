import math
import random
from collections import defaultdict

from tessel.llm import mixing


def water(sizes, weights=(3, 1, 2), share=1.5, limit=2):
    """Targets by capping one source after another."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level >= limit * sizes[s]}
        if not over:
            return target | {s: w[s] * level for s in free}
        for s in over:
            target[s] = limit * sizes[s]
            left -= target[s]
        free -= over
    return target


def docs_of(n, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(["w"] * int(rng.paretovariate(1) * 5 % 400)), "en", rng.choice(["b", "a", "c", "é", None, "a", "a"])) for i in range(n)]


def test_targets_and_taken(documents):
    docs = docs_of(1500)
    found = mixing.taken(documents(*docs)).collect()
    size, words, longest, target = defaultdict(int), defaultdict(int), defaultdict(int), {}
    source = {d[0]: d[3] for d in docs}
    for r in found:
        s = source[r["doc_id"]]
        size[s] += r["size"]
        words[s] += r["taken"]
        longest[s] = max(longest[s], r["size"])
        target[s] = r["target"]
        assert r["size"] == len(docs[r["doc_id"]][1].split()) and r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    want = water(size)
    for s in size:
        assert math.isclose(target[s], want[s], rel_tol=1e-9)
        assert abs(words[s] - target[s]) <= max(2 * longest[s], 0.03 * target[s])
    assert all(r["source_size"] == size[source[r["doc_id"]]] for r in found)
    again = mixing.taken(documents(*docs).repartition(7)).collect()
    assert sorted(again) == sorted(found)


def test_copies_follow_boundaries(documents, rows):
    df = documents(*[(i, "a b c", "en", "s") for i in range(40)])
    m = mixing.mixed(df)
    assert m.columns == df.columns
    counts = rows(m.groupBy("doc_id").count())
    assert sum(n for _, n in counts) == 60 and {n for _, n in counts} == {1, 2}


def test_odd_rows(documents, rows):
    df = documents((None, None, None, None), (1, "", None, "a"), (1, "", None, "a"), (2, " \t\x0b ", None, "b"), (3, "x" * 100_000, None, "c"), (3, "x" * 100_000, None, "c"))
    assert rows(mixing.taken(df).drop("taken")) == [(1, 0, 0, 0.0), (1, 0, 0, 0.0), (2, 0, 0, 0.0), (3, 1, 2, 3.0), (3, 1, 2, 3.0), (None, 0, 0, 0.0)]
    assert sum(r["taken"] for r in mixing.taken(df).collect()) == 3
    assert rows(mixing.taken(df.where("false"))) == []
    assert rows(mixing.mixed(df.where("false"))) == []


def test_equal_rows_are_counted(documents, rows, monkeypatch):
    """Rows without ids and repeated rows, in runs longer than are made at once, are taken as often as single ones of their size."""
    monkeypatch.setattr(mixing, "RUN", 16)
    docs = [(None if i % 3 else i, "a b c" if i % 2 else "a b c d", None, "s") for i in range(300)] + [(7, "a", None, "t")] * 100 + [(None, None, None, "t")] * 40
    found = rows(mixing.taken(documents(*docs)))
    assert len(found) == len(docs)
    each = rows(mixing.mix(documents(*docs)).selectExpr("doc_id", "size", "source_size", "target", "copies * size AS taken"))
    assert found == each
