"""Vectorised hashes of byte ranges, words and shingles (numpy, 62 bits, the same on every machine), and exact numbers of shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
PRIME = (1 << 31) - 1
#: Of the two polynomials modulo PRIME that make up a hash; drawn once.
POINTS = (1_481_765_933, 1_070_739_127)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all others."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME for x < 2^62, but that PRIME may stand for 0."""
    x = (x & U(PRIME)) + (x >> U(31))
    return (x & U(PRIME)) + (x >> U(31))


CODES = mix(np.arange(1, 513, dtype=U) * U(BASE)).reshape(2, 256) % U(PRIME)  # two random numbers for each byte value


def powers(n: int) -> list[np.ndarray]:
    """point^i and point^-i modulo PRIME for i < n at least, for both points."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _powers.clear()
        for base in (x for point in POINTS for x in (point, pow(point, -1, PRIME))):
            out = np.ones(size, U)
            done, step = 1, base
            while done < size:  # the next as many again, by one factor
                out[done : 2 * done] = out[:done] * U(step) % U(PRIME)
                done, step = 2 * done, step * step % PRIME
            _powers.append(out)
    return _powers


class Ranges:
    """Hashes of any ranges of one byte array: two polynomials over a prime field, which no structure of texts makes collide."""

    def __init__(self, a: np.ndarray):
        p = powers(len(a) + 1)
        self.sides = []
        for code, up, down in ((CODES[0], p[0], p[1]), (CODES[1], p[2], p[3])):
            sums = np.zeros(len(a) + 1, U)
            np.cumsum(reduced(code[a] * up[: len(a)]), out=sums[1:])
            self.sides.append((sums, down))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x, y = (reduced((sums[end] - sums[start]) % U(PRIME) * down[start]) % U(PRIME) for sums, down in self.sides)
        return mix((x << U(32)) + y + (end - start).astype(U) * U(BASE))


def exact_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """For each text the numbers of its distinct n-word shingles (shorter texts are one): equal for equal words, in all of these texts. Nothing is hashed away."""
    lower = LOWER.tobytes()
    words = pc.ascii_split_whitespace(pa.array([t.translate(lower) for t in texts], pa.large_binary()).view(pa.large_string()))
    words = pc.list_flatten(words).dictionary_encode(), pc.list_value_length(words).to_numpy(zero_copy_only=False)
    flat, sizes = words[0].indices.to_numpy().astype(np.int64), words[1].astype(np.int64)
    held = pc.binary_length(words[0].dictionary).to_numpy(zero_copy_only=False)[flat] > 0 if len(flat) else np.zeros(0, bool)
    owner = np.repeat(np.arange(len(texts)), sizes)[held]
    sizes = np.bincount(owner, minlength=len(texts))
    # each text's words, then n - 1 times a number that is no word
    none, starts = len(words[0].dictionary), np.cumsum(sizes + n - 1) - sizes - n + 1
    s = np.full(int((sizes + n - 1).sum()) + n, none)
    s[np.arange(len(owner)) + owner * (n - 1)] = flat[held]
    at = np.concatenate([np.arange(a, a + max(m - n + 1, min(m, 1))) for a, m in zip(starts.tolist(), sizes.tolist(), strict=True)]) if len(texts) else np.zeros(0, np.int64)
    number = s[at]
    for j in range(1, n):
        number = np.unique(number * (none + 1) + s[at + j], return_inverse=True)[1]
    cuts = np.cumsum(np.maximum(sizes - n + 1, np.minimum(sizes, 1)))[:-1]
    return [np.unique(x) for x in np.split(number, cuts)] if len(texts) else []


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles, A-Z lower-cased; shorter texts are one shingle."""
    return _hashed(texts, n)[0]


def shingle_counts(texts: list[bytes], n: int) -> np.ndarray:
    """How many distinct shingles each text has: distinct hashes are of distinct shingles; where hashes recur, the words tell."""
    sets, counts = _hashed(texts, n)
    out = np.array([len(x) for x in sets], np.int64)
    again = np.flatnonzero(out < np.array(counts, np.int64))
    for i, j in runs([len(texts[k]) for k in again], 1 << 22):
        out[again[i:j]] = [len(x) for x in exact_sets([texts[k] for k in again[i:j]], n)]
    return out


def runs(sizes: list[int], most: int):
    """(start, end) of neighbours of that size together, or single larger ones."""
    at = 0
    while at < len(sizes):
        to, size = at, 0
        while to < len(sizes) and (to == at or size + sizes[to] <= most):
            size += sizes[to]
            to += 1
        yield at, to
        at = to


def _hashed(texts: list[bytes], n: int) -> tuple[list[np.ndarray], list[int]]:
    """Each text's sorted distinct hashes of shingles, and its number of shingles."""
    sets, counts = [], []
    for i, j in runs([len(t) + 1 for t in texts], 1 << 20):
        a = LOWER[np.frombuffer(b" " + b" ".join(texts[i:j]) + b" ", dtype=np.uint8)]
        blank = BLANK[a]
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        starts, ends = edges[::2], edges[1::2]
        w = Ranges(a)(starts, ends)
        bounds = np.searchsorted(starts, np.cumsum([1, *[len(t) + 1 for t in texts[i:j]]]))
        s = np.zeros(max(len(w) - n + 1, 0), U)
        for k in range(n):
            s = s * U(BASE) + w[k : k + len(s)]
        s = mix(s)
        for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            counts.append(max(y - x - n + 1, min(y - x, 1)))
            if y - x >= n:
                sets.append(np.unique(s[x : y - n + 1]))
            elif y > x:
                short = U(y - x)
                with np.errstate(over="ignore"):
                    for one in w[x:y]:
                        short = short * U(BASE) + one
                sets.append(mix(np.array([short])))
            else:
                sets.append(np.zeros(0, U))
    return sets, counts
