import random
import zlib

import numpy as np
import pytest

from tessel.llm import langid

SYLLABLES = {"xa": ["ka", "to", "mi", "ren", "su"], "yo": ["äl", "ör", "ung", "sch", "ein"], "zu": ["que", "ción", "ñar", "los", "ado"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    return [(i, text(rng, lang, rng.randrange(3, 60)), lang) for i in range(400) for lang in [rng.choice(sorted(SYLLABLES))]]


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def frame(documents, rows):
    return documents(*[(*r, None) for r in rows])


def test_held_out_accuracy_and_calibration(documents, corpus):
    found = {r["doc_id"]: r for r in langid.identify(frame(documents, corpus)).collect()}
    test = [(i, lang) for i, _, lang in corpus if held(i)]
    assert all(found[i]["held_out"] == held(i) for i, *_ in corpus)
    assert sum(found[i]["lang_pred"] == lang for i, lang in test) >= 0.98 * len(test)
    scores = [found[i]["score"] for i, _ in test]
    assert all(1 / 3 <= s <= 1 for s in scores) and np.mean(scores) > 0.9


def test_only_learning_documents_count(documents, corpus):
    """Labels of held-out documents, and any source, change nothing."""
    lies = [(i, t, "yo" if held(i) else lang) for i, t, lang in corpus]
    a, b = (sorted(map(tuple, langid.identify(frame(documents, rows)).collect())) for rows in (corpus, lies))
    assert a == b


def test_odd_rows(documents, corpus):
    odd = [(1000, None, "xa"), (1001, "", "xa"), (1002, "123 .,!", "yo"), (None, "kato miren", None), (1003, "KATO " * 50_000, None), (1004, "kato", None), (1004, "kato", None)]
    got = [r for r in langid.identify(frame(documents, corpus + odd)).collect() if r["doc_id"] is None or r["doc_id"] >= 1000]
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert len(got) == 7 and all(by[i] == ("und", 0.0) for i in (1000, 1001, 1002))
    assert by[1003][0] == by[None][0] == by[1004][0] == "xa"
    assert langid.identify(frame(documents, corpus).where("false")).collect() == []
    nothing = langid.identify(frame(documents, [(1, "kato", None)])).collect()
    assert [(r["lang_pred"], r["score"]) for r in nothing] == [("und", 0.0)]


def test_sample_is_bounded_where_rows_lack_ids(documents, corpus, monkeypatch):
    """Texts without ids are drawn one by one, repeated rows once; the driver gets the model only."""
    drawn = []
    keep = langid.table
    monkeypatch.setattr(langid, "table", lambda df, label: (drawn.append(keep(df, label)) or drawn[-1]))
    monkeypatch.setattr(langid, "drop", lambda *_: None)
    many = [(None, t, lang) for _, t, lang in corpus] + [(5, "kato miren suren", "xa")] * 500
    model = langid.fitted(frame(documents, many), sample=90)
    rows = drawn[0][0].collect()
    assert 30 < len(rows) < 180 and len({r["u"] for r in rows}) == len(rows)
    assert sum(model(t)[0] == lang for _, t, lang in corpus) >= 0.95 * len(corpus)


def test_recognised_keeps_clean_rows(documents, corpus):
    df = frame(documents, [*corpus, (1000, "12 34", "xa"), (1001, None, None)])
    kept = langid.recognised(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, *_ in corpus)


def test_features_count_grams():
    ids, counts = langid.features("Ab, ab")
    assert counts.sum() == len(" ab ab ") + len(" ab ab ") - 1 + len(" ab ab ") - 2
    assert len(langid.features("1 2")[0]) == 0
    long = langid.features("ab " * 5000)
    assert (long[0] == np.unique(np.concatenate([long[0]]))).all() and long[1].sum() > 20_000


def test_penalties_make_it_sparse():
    rng = np.random.default_rng(1)
    model = langid.Ftrl(2, l1=1.0)
    for _ in range(300):
        y = int(rng.integers(2))
        ids = np.unique(np.append(rng.integers(10, 5000, 20), y))
        model.learn(ids, np.full(len(ids), 1 / np.sqrt(len(ids))), y)
    w = model.weights()
    assert (w == 0).mean() > 0.9 and w[0, 0] > 0 > w[1, 0]


def test_temperature_flattens_overconfidence():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 500)
    right = rng.random(500) < 0.7
    s = np.zeros((500, 2))
    s[np.arange(500), np.where(right, y, 1 - y)] = 10.0
    t = langid.calibrate(s, y)
    assert abs(langid.softmax(s / t).max(axis=1).mean() - 0.7) < 0.03
