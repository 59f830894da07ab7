import hashlib
import random

import numpy as np
import pytest

from tessel.llm import repeats


def brute(docs, length):
    raw = [(i, (t or "").encode()) for i, t in docs]
    seen = {}
    for _, b in raw:
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] = seen.get(b[p : p + length], 0) + 1
    out = []
    for i, b in raw:
        cut = []
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                if cut and cut[-1][1] >= p:
                    cut[-1][1] = p + length
                else:
                    cut.append([p, p + length])
        kept, at = b"", 0
        for s, e in cut:
            kept, at = kept + b[at:s], e
        out.append((i, len(b), sum(e - s for s, e in cut), len(cut), hashlib.sha256(kept + b[at:]).hexdigest()))
    return sorted(out, key=repr)


def made(seed, n=60):
    rng = random.Random(seed)
    noise = lambda k: "".join(rng.choice("abcdé ") for _ in range(k))
    passages = [noise(rng.randrange(15, 60)) for _ in range(6)]
    docs = [(i, noise(rng.randrange(40)) + rng.choice(passages)[rng.randrange(4) :] + noise(rng.randrange(40)) + (rng.choice(passages) if i % 3 else "")) for i in range(n)]
    return docs + [(100, "ab" * 60), (101, "z" * 90), (102, None), (None, ""), (103, "short"), (103, "short"), (104, passages[0]), (104, passages[0]), (105, passages[1])]


@pytest.mark.parametrize("limit", [repeats.TREE_LIMIT, 1])
@pytest.mark.parametrize("piece", [repeats.PIECE, 50])
def test_against_brute_force(documents, rows, monkeypatch, limit, piece):
    monkeypatch.setattr(repeats, "PIECE", piece)
    docs = made(7)
    assert rows(repeats.dedup(documents(*docs), length=20, k=6, tree_limit=limit)) == brute(docs, 20)


def test_anchor_in_very_many_contexts(documents, rows):
    """One passage, shared in parts of any length on both sides, in more contexts than a task's tree takes."""
    rng = random.Random(9)
    noise = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    passage = noise(44)
    docs = [(i, noise(20) + passage[rng.randrange(12) : 44 - rng.randrange(12)] + noise(20)) for i in range(400)]
    expected = brute(docs, 20)
    for limit in (repeats.TREE_LIMIT, 30, 2):
        assert rows(repeats.dedup(documents(*docs), length=20, k=6, tree_limit=limit)) == expected


def test_more_contexts_than_the_limit(documents, rows):
    docs = [(i, f"{i:08d}" + "the passage all share" + f"{i * 7919 % 9000:08d}") for i in range(repeats.TREE_LIMIT + 300)]
    got = rows(repeats.dedup(documents(*docs), length=20, k=6))
    assert got == brute(docs, 20)


def test_kept_texts_and_spans(documents):
    docs = made(11, n=25)
    got = []
    for r in repeats.cleaned(documents(*docs), length=20, k=6).collect():
        got.append((r["doc_id"], r["n_bytes"], sum(x["end"] - x["start"] for x in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()))
        raw = [(t or "").encode() for i, t in docs if i == r["doc_id"]]
        cuts = [0, *(p for x in r["spans"] for p in (x["start"], x["end"])), r["n_bytes"]]
        assert any(bytes(r["kept"]) == b"".join(b[i:j] for i, j in zip(cuts[::2], cuts[1::2], strict=True)) for b in raw)
    assert sorted(got, key=repr) == brute(docs, 20)


def test_pieces_of_long_texts(monkeypatch):
    """Anchors don't depend on how texts are cut into pieces."""
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"ab") for _ in range(n)) for n in (500, 19, 20, 64, 1000)]

    def found(piece):
        monkeypatch.setattr(repeats, "PIECE", piece)
        return sorted(zip(*(np.concatenate(x).tolist() for x in zip(*repeats.anchors(texts, 20, 6), strict=True)), strict=True))

    assert found(1 << 20) == found(30) == found(333)


def test_intervals_of_a_suffix_array():
    # suffixes of banana: a ana anana banana na nana
    assert sorted(repeats.intervals([1, 3, 0, 0, 2])) == [(1, 0, 2), (2, 4, 5), (3, 1, 2)]


def test_maximal_repeats_have_all_occurrences():
    # the bytes before and after an anchor in four texts; lefts are reversed
    lefts, rights = [b"xa", b"xa", b"yb", b"xb"], [b"KLMp", b"KLMq", b"KLMp", b"KLz"]
    got = {(a, b, tuple(sorted(w.tolist()))) for a, b, w in repeats.maximal_repeats(lefts, rights, 3)}
    assert {(2, 3, (0, 1)), (0, 4, (0, 2)), (0, 3, (0, 1, 2)), (1, 2, (0, 1, 3))} <= got


def test_groups_name_occurrences(spark):
    passage = "the same words over and over"
    texts = spark.createDataFrame([(0, "AAA " + passage + " BBB"), (1, "CC " + passage + " DD"), (2, "E " + passage + " FFFF")], "tid long, text string")
    found, groups, _ = repeats.repeat_groups(texts, len(passage) + 2, 6)
    spans = found.join(groups, ["h", "cx"]).selectExpr("tid", "pos - before as s", "pos + after as e", "repeat").collect()
    raw = {r["tid"]: r["text"] for r in texts.collect()}
    longest = {(r["tid"], raw[r["tid"]][r["s"] : r["e"]]) for r in spans if r["e"] - r["s"] == len(passage) + 2}
    assert longest == {(i, f" {passage} ") for i in range(3)}


def test_empty(documents, rows):
    assert rows(repeats.dedup(documents((1, "a")).where("false"))) == []
    assert rows(repeats.dedup(documents((1, "a" * 300)))) == [(1, 300, 300, 1, hashlib.sha256(b"").hexdigest())]


def test_only_what_the_result_reads_is_left(spark, documents):
    from test_pipeline import tables

    docs = documents((1, "abc " * 100), (2, "abc " * 100), (3, "x"))
    before = tables(spark)
    out = repeats.dedup(docs)
    assert sorted(n.split("-")[0] for n in tables(spark) - before) == ["digests", "rows"]
    assert out.count() == 3
    before = tables(spark)
    assert repeats.cleaned(docs).count() == 3
    assert sorted(n.split("-")[0] for n in tables(spark) - before) == ["cleaned", "rows"]
