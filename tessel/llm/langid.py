"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Lower-cased texts with every run of non-letters turned into one blank give n-grams of one to three characters, hashed
to ``DIM`` features. Document frequencies are counted over all learning documents. The model is fitted on a sample of
them by follow-the-regularised-leader with elastic-net penalties, so most weights are zero; its temperature is then
set on a held-back part of the sample. The sample is drawn by a digest of id and text, evenly over the languages, holds
repeated rows once, and has about ``sample`` documents in all, whatever the input's size. One task streams it once for
each epoch, a batch at a time, so neither that task nor the driver holds more than the model.

Defined results: a text that is null or has no letters is ``und`` with score 0, as is every text if nothing can be
learned; rows with null lang are predicted but not learned from; a null id counts as the empty string; repeated rows
are separate rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, drop, map_arrow, small_batches, table

DIM = 1 << 15
SAMPLE = 4000
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams and how often each occurs; both empty without letters."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters()[a]
    if not is_letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.concatenate([[32], np.where(is_letter, a, 32), [32]]).astype(np.uint32)
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
    grams, h = [], np.zeros(len(c), np.uint32)
    for n in range(1, 4):
        h = h[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :] * np.uint32(0x9E3779B1)
        x = h ^ np.uint32(n * 0x85EBCA6B % 2**32)
        x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        grams.append((x ^ (x >> np.uint32(13))) & np.uint32(DIM - 1))
    x = np.concatenate(grams)
    if len(x) < 2000:
        ids, counts = np.unique(x, return_counts=True)
        return ids.astype(np.int64), counts
    counts = np.bincount(x, minlength=DIM)
    ids = np.flatnonzero(counts)
    return ids, counts[ids]


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf
    return x / np.sqrt((x * x).sum())


def _frequencies(batches):
    df, n = np.zeros(DIM + 1, np.int64), 0
    for b in batches:
        for t in b.column("text").to_pylist():
            df[features(t or "")[0]] += 1
            n += 1
    df[DIM] = n
    held = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], ["feature", "n"])


def _counts(batches):
    for b in batches:
        rows = [features(t or "") for t in b.column("text").to_pylist()]
        at = pa.array(np.cumsum([0, *[len(i) for i, _ in rows]]).astype(np.int32))
        flat = [np.concatenate([r[k] for r in rows] or [np.zeros(0)]) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("u"), pa.ListArray.from_arrays(at, pa.array(flat[0].astype(np.int16))), pa.ListArray.from_arrays(at, pa.array(flat[1].astype(np.int32)))], ["lang", "u", "ids", "counts"])


class Ftrl:
    """Multinomial logistic regression, one document at a time; per-coordinate rates; penalties l1 and l2."""

    def __init__(self, classes: int, alpha=0.5, beta=1.0, l1=0.02, l2=0.02):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((DIM + 1, classes)), np.zeros((DIM + 1, classes))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, ids: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(ids)
        g = softmax(x @ w)
        g[y] -= 1
        g = x[:, None] * g
        old = self.n[ids]
        new = old + g * g
        self.z[ids] += g - (np.sqrt(new) - np.sqrt(old)) / self.alpha * w
        self.n[ids] = new


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def calibrate(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least cross-entropy, by golden section on its logarithm.

    One document's worth of doubt is spread over all languages, so separable languages don't end in certainty.
    """
    if not len(y) or scores.shape[1] < 2:
        return 1.0
    doubt = 1 / (len(y) + scores.shape[1])
    want = np.full(scores.shape, doubt)
    want[np.arange(len(y)), y] = 1 - doubt * (scores.shape[1] - 1)
    loss = lambda u: -(want * np.log(np.maximum(softmax(scores / math.exp(u)), 1e-300))).sum(axis=1).mean()
    a, b, r = math.log(0.02), math.log(20), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return math.exp((a + b) / 2)


class Model:
    """Languages, weights (DIM + 1 rows, the last for the intercept), inverse document frequencies, temperature."""

    def __init__(self, languages, weights, idf, temperature):
        self.languages, self.weights, self.idf, self.temperature = languages, weights, idf, temperature

    def __call__(self, text: str | None) -> tuple[str, float]:
        ids, counts = features(text or "")
        if not len(ids) or not self.languages:
            return "und", 0.0
        s = _weigh(counts, self.idf[ids]) @ self.weights[ids] + self.weights[DIM]
        p = softmax(s / self.temperature)
        i = int(p.argmax())
        return self.languages[i], float(p[i])


def train(learn: DataFrame, sample: int = SAMPLE, epochs: int = 4) -> Model:
    """A model from rows (id, text, lang) with non-null lang."""
    spark = learn.sparkSession
    sizes = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    df = map_arrow(learn.select("text"), _frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()  # DIM + 1 rows at most
    count = np.zeros(DIM + 1)
    for r in df:
        count[r["feature"]] = r["n"]
    idf = np.log((1 + count[DIM]) / (1 + count[:DIM])) + 1
    u = (F.xxhash64(F.lit("langid"), F.coalesce(F.col("id").cast("string"), F.lit("")), "text").cast("double") / F.lit(2.0**64)) + 0.5
    rate = F.lit(0.0)
    for lang in languages:
        rate = F.when(F.col("lang") == lang, min(1.0, sample / len(languages) / sizes[lang])).otherwise(rate)
    # distinct: all copies of a row are drawn or none
    drawn = learn.withColumn("u", u).where(F.col("u") < rate).select("lang", "u", "text").distinct()
    rows, path = table(map_arrow(drawn, _counts, "lang string, u double, ids array<short>, counts array<int>"), "langid-sample")
    # a fixed shuffle, by digits of the digest that the draw doesn't use
    order = [F.col("u") * 2**30 % 1, "u", "lang", F.size("ids")]
    stream = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs)))).repartition(1).sortWithinPartitions("epoch", *order)
    weights, temperature = np.zeros((DIM + 1, len(languages)), np.float32), 1.0
    with small_batches(spark):
        fit = map_arrow(stream.select("epoch", "lang", "ids", "counts"), _fit(languages, idf, epochs), "feature int, w array<double>").toArrow()
    for feature, w in zip(fit["feature"].to_pylist(), fit["w"].to_pylist(), strict=True):
        if feature < 0:
            temperature = w[0]
        else:
            weights[feature] = w
    drop(spark, path)
    return Model(languages, weights, idf.astype(np.float32), temperature)


def _fit(languages: list[str], idf: np.ndarray, epochs: int):
    """Rows (epoch, lang, ids, counts), the same ones in the same order in each epoch, to (feature, w) of the weights that aren't zero, and the temperature at -1.

    Every fifth document is held back; the epoch after the last one gives the scores of those.
    """

    def run(batches):
        fit, weights, scores, wanted, last, k = Ftrl(len(languages)), None, [], [], None, 0
        for b in batches:
            ids, counts = b.column("ids"), b.column("counts")
            for i, (epoch, lang) in enumerate(zip(b.column("epoch").to_pylist(), b.column("lang").to_pylist(), strict=True)):
                if epoch != last:
                    last, k = epoch, 0
                at = ids[i].values.to_numpy().astype(np.int64)
                held = k % 5 == 4
                k += 1
                if not len(at) or held != (epoch == epochs):
                    continue
                x = np.append(_weigh(counts[i].values.to_numpy(), idf[at]), 1.0).astype(np.float32)
                at, y = np.append(at, DIM), languages.index(lang)
                if held:
                    weights = fit.weights() if weights is None else weights
                    scores.append(x @ weights[at])
                    wanted.append(y)
                else:
                    fit.learn(at, x, y)
        w = fit.weights()
        some = np.flatnonzero(w.any(axis=1))
        t = calibrate(np.array(scores).reshape(len(scores), len(languages)), np.array(wanted, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array([*w[some].tolist(), [t]], pa.list_(pa.float64()))], ["feature", "w"])

    return run


def _predict(model: Model):
    def run(batches):
        for b in batches:
            got = [model(t) for t in b.column("text").to_pylist()]
            rest = [b.column(i) for i, n in enumerate(b.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*[n for n in b.schema.names if n != "text"], "lang_pred", "score"])

    return run


def _recognised(model: Model, at: int, least: float):
    def run(batches):
        for b in batches:
            got = [model(t) for t in b.column(at).to_pylist()]
            yield b.filter(pa.array([lang != "und" and p >= least for lang, p in got], pa.bool_()))

    return run


def recognised(docs: DataFrame, least: float = 0.3, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs whose text has a language with a score of at least ``least``."""
    model = fitted(docs, sample, id_col, text_col, lang_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # any names may come in
    return map_arrow(plain, _recognised(model, docs.columns.index(text_col), least), plain.schema).toDF(*docs.columns)


def held_out(id_: Column) -> Column:
    """Documents that nothing is learned from: CRC-32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _plain(docs: DataFrame, id_col, text_col, lang_col) -> DataFrame:
    return docs.select(column(docs, id_col).alias("id"), column(docs, text_col).alias("text"), column(docs, lang_col).alias("lang"))


def fitted(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from the documents that aren't held out."""
    rows = _plain(docs, id_col, text_col, lang_col)
    return train(rows.where(~held_out(F.col("id")) & F.col("lang").isNotNull()), sample)


def identify(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    model = fitted(docs, sample, id_col, text_col, lang_col)
    rows = _plain(docs, id_col, text_col, lang_col).select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "text")
    return map_arrow(rows, _predict(model), f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")
