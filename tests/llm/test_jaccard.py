import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tessel.llm import jaccard
from tessel.llm.components import components
from tessel.llm.hashing import Ranges, exact_sets, shingle_counts, shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(docs, n):
    out = []
    for _, t in docs:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[j : j + n]) for j in range(max(len(w) - n + 1, 1))} if w else set())
    return out


def brute(docs, n=3, percent=90):
    sets, parent = sets_of(docs, n), list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted([(i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(docs)], key=repr)


def made(seed, bases=6, copies=14):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs, i = [], 0
    for _ in range(bases):
        base = [rng.choice(words) for _ in range(rng.randrange(2, 120))]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randrange(1 + len(t) // 25)):
                t[rng.randrange(len(t))] = rng.choice(words)
            docs.append((i, (" " if i % 2 else "\n").join(t).upper() if i % 5 == 0 else " ".join(t)))
            i += 1
    rng.shuffle(docs)
    return docs + [(500, None), (500, ""), (501, " \t\x0b"), (None, "lone text here now"), (None, "lone text here now"), (502, "one"), (503, "ONE"), (504, "one two"), (505, "\x1c one"), (506, "a a a a a a"), (507, "a a a"), (508, "z " * 30_000)]


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80)])
@pytest.mark.parametrize("centres", [jaccard.CENTRES, 2])
def test_against_brute_force(documents, rows, monkeypatch, words, percent, centres):
    monkeypatch.setattr(jaccard, "CENTRES", centres)
    monkeypatch.setattr(jaccard, "SALT", 4096 if centres > 2 else 3)
    docs = made(words)
    assert rows(jaccard.report(documents(*docs), words=words, percent=percent)) == brute(docs, words, percent)


@pytest.mark.parametrize("percent", [67, 80, 90, 100])
def test_similar_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    p = jaccard.PartEnum(percent)
    for _ in range(300):
        n = int(rng.integers(1, 300))
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        gone = int(rng.integers(0, n // 3 + 1))
        y = np.concatenate([x[gone:], rng.integers(0, 2**63, int(rng.integers(0, n // 3 + 1))).astype(np.uint64)])
        both = n - gone
        if 100 * both >= percent * (len(x) + len(y) - both) and len(y):
            assert set(p.signatures(x).tolist()) & set(p.signatures(y).tolist())
            differ = np.bitwise_count(np.bitwise_xor(*jaccard._fold(s := [jaccard.sketch(x), jaccard.sketch(y)], min(map(len, s))))).sum()
            assert differ <= len(x) + len(y) - 2 * both <= jaccard.most_apart(np.array([len(x) + len(y)]), percent)[0]


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate({97: 98, 98: 97})
    return word[:n], word[:n].translate({97: 98, 98: 97})


def test_shingles_match_plain_sets():
    x, y = thue_morse(1024)
    docs = [*made(9), (600, f"p q {x} r s p q {y} r s"), (601, "a b a b a b a"), (602, "k l"), (603, "K L k")]
    raw = [(t or "").encode() for _, t in docs]
    for n in (1, 3, 5):
        sets = sets_of(docs, n)
        assert [len(x) for x in shingle_sets(raw, n)] == [len(x) for x in exact_sets(raw, n)] == shingle_counts(raw, n).tolist() == [len(s) for s in sets]
        exact = exact_sets(raw, n)
        assert all(len(np.intersect1d(exact[i], exact[j])) == len(sets[i] & sets[j]) for i, j in itertools.combinations(range(0, len(raw), 3), 2))
    assert exact_sets([], 3) == [] and [len(x) for x in exact_sets([b"", b" "], 3)] == [0, 0]


def test_words_that_collide_in_polynomials_modulo_powers_of_two(documents, rows):
    x, y = thue_morse(1024)
    a = np.frombuffer(f"{x}{y}".encode(), np.uint8)
    assert len(set(Ranges(a)(np.array([0, 1024]), np.array([1024, 2048])).tolist())) == 2
    docs = [(1, f"p q {x} r s"), (2, f"p q {y} r s"), (3, f"p q {x} r s p q {y} r s")]
    assert rows(jaccard.report(documents(*docs))) == brute(docs) == [(1, 3, 1), (2, 3, 2), (3, 8, 3)]


def test_links_are_verified_on_words():
    """Even if all words had the same hash, no link and no size would be wrong."""
    texts = [b"p q r s", b"t u v w", b"t U v w x", b"t u"]
    verify = jaccard._verifier(3, 60)
    batch = pa.RecordBatch.from_pydict({"u": [0, 1, 0], "v": [1, 2, 3], "tu": [texts[0], texts[1], texts[0]], "tv": [texts[1], texts[2], texts[3]]})
    assert [b.to_pydict() for b in verify([batch])] == [{"u": [1], "v": [2]}]


def test_keep_one(documents):
    docs = made(4)
    df = documents(*docs)
    kept = jaccard.keep_one(df, words=3, percent=90)
    assert kept.columns == df.columns
    classes = brute(docs)
    full = {c for _, n, c in classes if n}
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(map(repr, got)) == sorted([repr(c) for c in full] + [repr(i) for i, n, _ in classes if not n])


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(300, 200), (201, 300), (7, 7)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long"))[0].collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {300: 200, 200: 200, 201: 200}


def key(text):
    return hashlib.sha256((text or "").encode()).hexdigest()[:32]


@pytest.mark.parametrize("centres", [jaccard.CENTRES, 2])
def test_every_link_between_different_texts(documents, rows, monkeypatch, centres):
    monkeypatch.setattr(jaccard, "CENTRES", centres)
    body = " ".join(f"v{i}" for i in range(60))  # a group in which all link, larger than the first round's centres
    docs = made(5, bases=2, copies=6) + [(None, "lone text here now"), (502, "one")] + [(600 + i, f"{body} end{i}") for i in range(70)]
    sets = dict(zip([t or "" for _, t in docs], sets_of(docs, 3), strict=True))
    pairs = set()
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
            pairs.add(tuple(sorted((key(a), key(b)))))
    df = documents(*docs)
    assert rows(jaccard.links(df)) == sorted(pairs, key=repr) and len(pairs) >= 70 * 69 // 2
    count = {k: sum(k in p for p in pairs) for k in map(key, sets)}
    assert rows(jaccard.linked(df)) == sorted([(i, key(t), count[key(t)]) for i, t in docs], key=repr)


def test_links_of_nothing(documents, rows):
    assert rows(jaccard.links(documents((1, "a"), (2, None)))) == rows(jaccard.linked(documents((1, "a")).where("false"))) == []


def test_empty(documents, rows):
    assert rows(jaccard.report(documents((1, "a")).where("false"))) == []
    assert rows(jaccard.keep_one(documents((1, "a")).where("false"))) == []
