import itertools
import random
import zlib
from collections import defaultdict

import pytest

from tessel.llm import sharding


def smallest(sizes, shards):
    """The least capacity by trying every one between bounds, greedily."""

    def fits(c):
        n, left = 1, c
        for s in sizes:
            if s > left:
                n, left = n + 1, c
            left -= s
        return n <= shards

    c = max([max(sizes), -(-sum(sizes) // shards)])
    while not fits(c):
        c += 1
    return c


def check(found, docs, shards):
    by, slots, of = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in found:
        by[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        of[r["text_crc32"]].add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of.values())
    want = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in found) == want
    return by


@pytest.mark.parametrize("bins", [4, 64, 1 << 15])
def test_capacity_is_minimal(documents, bins):
    rng = random.Random(bins)
    docs = [(i, "x" * int(rng.paretovariate(0.8) * 10 % 5000) + str(rng.randrange(200))) for i in range(400)]
    df = documents(*docs)
    found = sharding.minimax_shards(df, shards=7, bins=bins).collect()
    by = check(found, docs, 7)
    size, order = defaultdict(int), {}
    import hashlib

    for _, t in docs:
        key = hashlib.sha256(t.encode()).hexdigest()[:32]
        size[key] += len(t) + 8
        order[key] = 1
    assert max(by.values()) == smallest([size[k] for k in sorted(order)], 7) or max(by.values()) < smallest([size[k] for k in sorted(order)], 7) + 1
    assert min(by.values()) > 0


def test_hot_group_and_odd_rows(documents):
    docs = [(i, "same text") for i in range(300)] + [(None, None), (None, ""), (5, None), (1, "b"), (1, "b"), (2, "c" * 40_000)]
    by = check(sharding.minimax_shards(documents(*docs), shards=24).collect(), docs, 24)
    assert max(by.values()) == 40_008


def test_near_equal(documents):
    docs = [(i, f"{i} " * 30) for i in range(2000)]
    by = check(sharding.minimax_shards(documents(*docs)).collect(), docs, 24)
    assert len(by) == 24 and max(by.values()) < 1.05 * min(by.values())


def test_empty(documents):
    assert sharding.minimax_shards(documents((1, "a")).where("false")).collect() == []


def test_even_cuts_have_the_least_squares():
    rng = random.Random(3)
    for _ in range(200):
        sizes = [int(rng.paretovariate(0.7) * 5) % 300 + 1 for _ in range(rng.randrange(1, 12))]
        shards = rng.randrange(1, 6)
        points, capacity = [0], smallest(sizes, shards)
        for x in sizes:
            points.append(points[-1] + x)
        cuts = sharding._even(sharding.np.array(points), capacity, shards)
        ways = [(0, *c, points[-1]) for c in itertools.combinations_with_replacement(points, shards - 1)]
        squares = lambda w: sum((b - a) ** 2 for a, b in zip(w, w[1:]))
        found = (0, *cuts, points[-1])
        assert squares(found) == min(squares(w) for w in ways if all(b - a <= capacity for a, b in zip(w, w[1:])))


@pytest.mark.parametrize("share", [0.06, 0.1, 1 / 3, 0.999])
@pytest.mark.parametrize("hot", ["first", "last", "middle"])
def test_hot_group_leaves_no_shard_empty(spark, share, hot):
    """One group far larger than a mean shard, before, after and between small ones: 24 shards, all others near equal."""
    rng = random.Random(hot)
    sizes = [rng.randrange(20, 200) for _ in range(5000)]
    at = {"first": 0, "last": len(sizes), "middle": 1777}[hot]
    sizes.insert(at, int(sum(sizes) * share / (1 - share)))
    ends = list(itertools.accumulate(sizes))
    df = spark.createDataFrame([(e,) for e in ends], "end long")
    capacity, cuts = sharding._cuts(df, ends[-1], max(sizes), 24, 1 << 15)
    assert capacity == smallest(sizes, 24) and set(cuts) <= set(ends)
    shards = [b - a for a, b in zip([0, *cuts], [*cuts, ends[-1]], strict=True)]
    others = sorted(shards)[:-1]
    assert max(shards) <= capacity and min(shards) > 0
    assert max(others) < 1.5 * min(others) if hot == "middle" else max(others) < 1.1 * min(others)


def test_hot_rows_leave_no_shard_empty(documents):
    docs = [(i, f"{i} " * 30) for i in range(2000)] + [(i, "hot " * 250) for i in range(60)]
    by = check(sharding.minimax_shards(documents(*docs)).collect(), docs, 24)
    assert len(by) == 24 and max(by.values()) == 60 * 1008


def test_equal_rows_have_slots_of_their_own(documents, monkeypatch):
    """Rows without ids and repeated rows, a third of all each, in runs longer than are made at once."""
    monkeypatch.setattr(sharding, "RUN", 16)
    docs = [(i, f"{i} " * 30) for i in range(200)] + [(None, f"{i} none") for i in range(200)] + [(7, "again")] * 200 + [(None, None)] * 33
    by = check(sharding.minimax_shards(documents(*docs), shards=5).collect(), docs, 5)
    assert len(by) == 5
