import random
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessel.llm import tokens
from tessel.llm.common import shared_dir

public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_coder_equals_whole_texts(whole, monkeypatch):
    rng = random.Random(1)
    pieces = ["a", "B", "É", "é", "ß", "H̱", "İ", "ΑΣ", "'s", "'LL", "don't", "<|endoftext|>", "<|STARTOFTEXT|>", "<|", "12", "½", "\x0b", "\x1c", " ", "\u0085", "\n", " ", " ", "\t", ".", "!?", ")", "—", "日本", "ᄀ", "ᅡ", "é", "K", "😀", "\x00", "_", "Word", "thing"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(14))) for _ in range(1500)]
    for limit in (tokens.CACHED_PIECES, 50):
        monkeypatch.setattr(tokens, "CACHED_PIECES", limit)
        coder = tokens.Coder(PATH)
        assert coder.simple and coder.apart
        for part in (texts[:700], texts[700:], [], [""]):
            assert encoded(coder, part) == [whole(t) for t in part]


def encoded(coder, texts):
    ids, sizes = coder(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []


def test_tokenizers_that_join_over_white_space_get_whole_texts():
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    coder, t = tokens.Coder(path), Tokenizer.from_file(path)
    texts = ["two words", "  lead", "", "tab\there \n\n done "]
    assert not coder.apart
    assert encoded(coder, texts) == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_texts_encoded_together(monkeypatch):
    monkeypatch.setattr(tokens, "TEXTS", 3)
    monkeypatch.setattr(tokens, "BYTES", 10)
    texts = pa.array(["a" * 20, "b", "", None, "c" * 9, "dd", "e" * 10, "f"])
    parts = list(tokens._parts(texts))
    assert [p[0] for p in parts] == [0, *np.cumsum([p[1] for p in parts])[:-1].tolist()] and sum(p[1] for p in parts) == 8 and max(p[1] for p in parts) <= 3
    assert list(tokens._parts(pa.array([], pa.string()))) == []


def test_files_and_positions(spark, documents, rows, whole):
    docs = [(i * 7 % 50, f"Text number {i}, " * (i % 5)) for i in range(50)] + [(60, None), (61, ""), (62, "long " * 40_000), (63, "twice"), (63, "twice"), (63, "other")]
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    tokens.write(documents(*docs), path, PATH)
    files = tokens.read(spark, path)
    got = tokens.positions(files).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted(d[0] for d in docs)
    at, left = 0, {}
    for i, t in docs:
        left.setdefault(i, []).append(whole(t or "") + [2])
    for r in got:
        ids = next(x for x in left[r["doc_id"]] if len(x) == r["n_tokens"] and zlib.crc32(np.array(x, "<u4").tobytes()) == r["ids_crc32"])
        left[r["doc_id"]].remove(ids)
        assert r["start"] == at
        at += len(ids)
    assert rows(files.where("doc_id = 61").select("ids")) == [([2],)]


def test_files_have_indexes(spark, documents):
    orc = pytest.importorskip("pyarrow.orc")
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    tokens.write(documents(*[(i, "some words here") for i in range(3000)]), path, PATH, stride=1000)
    import glob

    part = next(f for f in glob.glob(path.removeprefix("file://") + "/*.orc") if orc.ORCFile(f).nrows)
    f = orc.ORCFile(part)
    assert f.row_index_stride == 1000 and f.nstripes >= 1
    plan = spark._jvm.PythonSQLUtils.explainString(tokens.read(spark, path).where("doc_id = 5")._jdf.queryExecution(), "formatted")
    assert "EqualTo(doc_id,5)" in plan


def test_odd_ids_and_empty(spark, documents, rows):
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    tokens.write(documents((None, "a"), (-5, "a")), path, PATH)
    assert [(r["doc_id"], r["start"]) for r in tokens.positions(tokens.read(spark, path)).orderBy("start").collect()] == [(None, 0), (-5, 2)]
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    tokens.write(documents((1, "a")).where("false"), path, PATH)
    assert rows(tokens.positions(tokens.read(spark, path))) == []
