"""Product codes against Lloyd's iterations without bounds."""

import hashlib
import random

import numpy as np
import pytest

from tessel.llm import codes

COLUMNS = "vec_id long, embedding array<float>, label int"


def brute(rows, parts, entries, rounds):
    rows = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max(len(v) for _, v, _ in rows)
    width = -(-width // parts) * parts
    x = np.array([[int(np.floor(1024 * c)) for c in v] + [0] * (width - len(v)) for _, v, _ in rows], object)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    w = width // parts
    code = [[None] * parts for _ in rows]
    error, held = [0] * len(rows), []
    for p in range(parts):
        y = x[:, p * w : (p + 1) * w]
        book = [list(y[i]) for i in order]
        for turn in range(rounds + 1):
            best = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(book)) for v in y]
            if turn < rounds:
                for j in range(len(book)):
                    own = [v for v, (_, b) in zip(y, best) if b == j]
                    if own:
                        book[j] = [sum(c) // len(own) for c in zip(*own)]
        for i, (d, j) in enumerate(best):
            code[i][p] = j
            error[i] += d
        held.append(book)
    sums = {}
    for (_, _, label), e in zip(rows, error):
        sums[label] = sums.get(label, 0) + e
    text = ",".join(str(c) for book in held for entry in book for c in entry)
    sha = hashlib.sha256(text.encode()).hexdigest()
    return sorted(((i, "".join(f"{j:02x}" for j in c), e, sums[label], sha) for (i, _, label), c, e in zip(rows, code, error)), key=repr)


def vectors(seed, n, width, spread):
    rng = random.Random(seed)
    rows = [(i * 3, [rng.choice([rng.gauss(0, 1), spread * rng.randrange(3)]) for _ in range(width)], rng.choice([None, 1, 2])) for i in range(n)]
    return [(i, [float(np.float32(c)) for c in v], label) for i, v, label in rows]


@pytest.mark.parametrize("seed, n, width, entries, spread", [(1, 300, 8, 40, 0.25), (2, 200, 6, 256, 0.0), (3, 150, 4, 5, 1.0), (4, 40, 8, 16, 0.0)])
def test_against_brute_force(spark, rows, seed, n, width, entries, spread):
    data = vectors(seed, n, width, spread)
    data += [data[0], data[1], (None, data[2][1], None), (7, None, 1), (8, [1.0, None], 1), (9, [float("nan")] * width, 1), (10, [float("inf")] * width, None), (11, [-2.5], 2)]
    df = spark.createDataFrame(data, COLUMNS).selectExpr("*", "'x' AS code", "'x' AS error", "'x' AS v", "'x' AS l").repartition(3)
    out = rows(codes.compress(df, entries=entries), "vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert out == brute(data, 4, entries, 4)


def test_ties_go_to_the_lower_index(spark, rows):
    data = [(i, [float(i % 2 * 2)] * 4, 0) for i in range(4)] + [(10, [1.0] * 4, 0)]
    df = spark.createDataFrame(data, COLUMNS)
    out = {r["vec_id"]: r["code"] for r in codes.compress(df, entries=4, rounds=0).collect()}
    assert out == {0: "00000000", 1: "01010101", 2: "00000000", 3: "01010101", 10: "00000000"}


def test_empty(spark):
    assert codes.compress(spark.createDataFrame([(1, None, 1)], COLUMNS)).collect() == []


def test_too_large_raises(spark):
    with pytest.raises(Exception, match="a component is beyond"):
        codes.compress(spark.createDataFrame([(1, [1e30] * 4, 1)], COLUMNS))


def test_bounds_stay_bounds_and_prune():
    """Rounded and shifted bounds never pass the distances, and most distances aren't calculated once entries move little."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 40, (100, 8)) for c in rng.normal(0, 400, (30, 8))]).astype(np.int64)
    book = x[rng.choice(len(x), 64, replace=False)]
    code, upper, lower = codes.first(x, book)
    calculated = []
    for _ in range(4):
        new = np.array([x[code == j].sum(axis=0) // max(1, (code == j).sum()) if (code == j).any() else book[j] for j in range(len(book))])
        m = codes.Movement(new, book)
        kept = codes.unpack(*codes.pack(lower), len(book))
        assert (kept <= lower).all()
        code, upper, lower, n = codes.again(x, m, code, upper, kept)
        book = new
        d = codes.dense(x, book)
        assert (code == d.argmin(axis=1)).all()
        assert (lower <= np.sqrt(d)).all() and (upper >= np.sqrt(d.min(axis=1))).all()
        calculated.append(n / d.size)
    assert calculated[-1] < 0.3


def test_dense_is_exact_for_large_numbers():
    rng = np.random.default_rng(1)
    for top in (1 << 10, 1 << 26):
        x, book = (rng.integers(-top, top, (20, 16)) for _ in "ab")
        assert (codes.dense(x, book) == ((x[:, None] - book) ** 2).sum(axis=2)).all()
