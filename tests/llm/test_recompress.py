"""Removal of repeated windows of words against brute force."""

import hashlib
import random

import numpy as np
import pytest

from tessel.llm import recompress
from tessel.llm.recompress import Piece, names_of


def words(text):
    return [] if text is None else text.encode().split()


def brute(rows, window):
    first = {}
    order = lambda i: (i is not None, i or 0)
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, (order(i), s)), (order(i), s))
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (order(i), s):
                gone |= set(range(s, s + window))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, vocabulary, n=60):
    rng = random.Random(seed)
    voice = [f"w{i}é" for i in range(vocabulary)]
    passages = [[rng.choice(voice) for _ in range(rng.randrange(5, 90))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randrange(0, 6)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            w += rng.choice([p, p[a:], p[:a], [rng.choice(voice) for _ in range(rng.randrange(40))], [rng.choice(voice)] * rng.randrange(50)])
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(w)))
    rows += [(100, rows[3][1]), (3, rows[3][1]), (101, None), (102, ""), (None, rows[5][1]), (None, rows[6][1]), (103, " \x0b " + rows[7][1] + "\x1f x"), (104, "la " * 500), (105, "la " * 19), (106, "lo li " * 300)]
    return rows


@pytest.mark.parametrize("seed, vocabulary, window", [(1, 2, 6), (2, 30, 6), (3, 1000, 20), (4, 3, 20), (5, 1, 20)])
def test_against_brute_force(documents, rows, seed, vocabulary, window):
    data = corpus(seed, vocabulary)
    docs = documents(*data).repartition(5)
    assert rows(recompress.report(docs, window=window), "doc_id", "n_words", "n_removed", "kept_sha256") == brute(data, window)


def test_texts_and_spans(documents):
    text = " ".join(f"a{i}" for i in range(30))
    out = {r["doc_id"]: r for r in recompress.cleaned(documents((1, text), (2, "x  y " + text + " z"))).collect()}
    assert out[1]["kept"] == text and out[1]["spans"] == []
    assert out[2]["kept"] == "x y z" and [tuple(s) for s in out[2]["spans"]] == [(2, 32)]


def test_empty(documents):
    assert recompress.report(documents((1, "a")).where("false")).collect() == []


def test_pieces_do_not_matter(documents, rows, monkeypatch):
    data = corpus(6, 5, 30)
    docs = documents(*data).coalesce(1)
    monkeypatch.setattr(recompress, "PIECE", 64)
    texts = [(t or "").encode() for _, t in data]
    seen = [(int(p.doc[a]), int(p.place[a])) for p in recompress.pieces(texts, 20) for a in p.at]
    assert sorted(seen) == [(i, s) for i, t in enumerate(texts) for s in range(len(t.split()) - 19)]
    for t in texts:
        assert len(names_of(t)[0]) == len(t.split())
    assert rows(recompress.report(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == brute(data, 20)


@pytest.mark.parametrize("vocabulary", [2, 4, 50])
def test_a_window_is_named_alike_wherever_it_is(vocabulary):
    """What a window's range holds on each level, and its anchor, don't depend on what surrounds it."""
    rng = np.random.default_rng(vocabulary)
    inside = rng.integers(1, vocabulary + 1, 20).astype(np.uint64)
    seen = set()
    for _ in range(50):
        left, right = (rng.integers(1, vocabulary + 1, rng.integers(0, 9)).astype(np.uint64) for _ in "ab")
        names = np.concatenate([left, inside, right])
        p = Piece(names, np.zeros(len(names), np.int64), np.arange(len(names)), 20).follow(3)
        at = len(left)
        ranges = [tuple(sym[lo[at] : hi[at]].tolist()) for sym, lo, hi in p.levels[1:]]
        seen.add((*ranges, int(p.anchors()[1][at])))
    assert len(seen) == 1
    assert vocabulary < 4 or seen.pop()[0]


def test_runs_and_pairs_shrink_a_sequence():
    names = np.array([7] * 30 + list(range(1, 200)), np.uint64)
    sym = Piece(names, np.zeros(len(names), np.int64), np.arange(len(names)), 20).follow(3).levels[-1][0]
    assert sym[0] != 7 and len(sym) < len(names) * 0.5


def test_names_tell_words_apart():
    words = [b"a", b"aa", b"a" * 8, b"a" * 9, b"a" * 16, b"a" * 17, b"b" + b"a" * 8, b"a" * 8 + b"b", b"\x00", b"\x00\x00", "é".encode(), b"a" * 40, b"a" * 41]
    names, starts = names_of(b"  " + b" \n".join(words))
    assert len(set(names.tolist())) == len(words) and starts[0] == 2
    assert (names_of(b" ".join(reversed(words)))[0][::-1] == names).all()
    assert names_of(b"")[0].size == names_of(b" \t ")[0].size == 0
