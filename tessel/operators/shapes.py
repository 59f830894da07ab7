"""Files of one shape are parsed once.

A file's shape is its text with words and numbers left open, except those that the parser compares with something. What
a file holds follows from its shape: its tokens' kinds, brackets, members and rows are the same for all files of a shape,
and each place is so many bytes after the begin of one of the text's pieces. So a worker parses a shape's second file for
its places (``Plan``), and later files of the shape are read by adding up the lengths of their pieces, for all files of a
batch at once. Files with what the rules below can't tell apart are parsed one by one, with the same rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import EXTRACTED, PARAM
from .syntax import CONTROL, LITERALS, MODIFIERS, OPERATORS, TYPE_WORDS

#: A run of characters of words, with a backslash (escapes) or slash (flags of a pattern, comments) before it
RUN = re.compile(r"([\\/]?[A-Za-z0-9_$\x80-\xff]+)")
PLAIN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
DIGITS = re.compile(r"[0-9]+\Z")
# All words that the parser or the extraction compares with something
WORDS = OPERATORS | CONTROL | MODIFIERS | TYPE_WORDS | LITERALS | frozenset("import export default from as satisfies is extends type const let var emits props computed methods required".split())
WRAPPER = "wrapComponentConfig"
#: Markers of private files; closing tags, which must be equal to their opening ones; characters that stand for what is left open
WHOLE = re.compile("@(?:private|experimental|internal)|</|[\x00\x01]")
LONGEST, KEPT, RUNS = 1 << 14, 1 << 26, 1 << 17  # characters of a file and of all shapes, different runs
KINDS = ("None", "TsMethod", "VueProp")
PARTS = tuple(PARAM.names)


class Unshared(Exception):
    """A shape whose files are to be parsed one by one."""


class _Open(dict):
    """What stands in a shape for a run: itself, or a mark for any word or number."""

    def __missing__(self, run: str) -> str:
        if len(self) > RUNS:
            self.clear()
        kept = "\0" if PLAIN.match(run) and run not in WORDS and WRAPPER not in run else "\1" if DIGITS.match(run) else run
        self[run] = kept
        return kept


class Plan:
    """Places of a shape's tokens and names, as (piece, bytes after its begin)."""

    def __init__(self, file, pieces: list[str]):
        ends = list(accumulate(map(len, pieces)))
        begins = [0, *ends[:-1]]
        src = file.src

        def at(place: int) -> tuple[int, int]:
            i = bisect_right(begins, place) - 1 if place < ends[-1] else len(pieces) - 1
            while i and begins[i] == place and not pieces[i]:  # nothing begins in an empty piece
                i -= 1
            off = place - begins[i]
            if i % 2 and 0 < off < len(pieces[i]) and MARKS[pieces[i]] != pieces[i]:
                raise Unshared
            # the end of an open run is where the next piece begins
            return (i + 1, 0) if i % 2 and off == len(pieces[i]) and i + 1 < len(pieces) else (i, off)

        named, found = file.plan()
        self.rows = len(found) + 1 if found else 0
        if not self.rows:
            self.names = []
            return
        self.names = [(*at(a), *at(b)) for a, b in named]
        tokens, spans, kinds, at_token, params, counts = [], [], [], [], [], []

        def token(span) -> int:
            if span is None:
                return -1
            a, b = span
            (r0, _), (r1, _) = src.point(a), src.point(b)
            raw = src.raw[a:b]
            tokens.append((*at(a), *at(b), r0, r1, *at(src.lines[r0]), *at(src.lines[r1]), file.normal(raw) != raw))
            return len(tokens) - 1

        self.members = []
        for kind, span, text, method, prop in [*found, (None, (0, 0), (0, 0), None, None)]:
            self.members.append(kind and f".{kind}.")
            spans.append((*at(span[0]), *at(span[1])))
            kinds.append(1 if method else 2 if prop else 0)
            row = [token(text)]
            row += [token(method["async"]), token(method["return_type"])] if method else [-1, -1]
            row += [token(x) for x in prop] if prop else [-1, -1]
            at_token.append(row)
            for p in method["parameters"] if method else ():
                params.append([token(p[x]) for x in PARTS])
            counts.append(len(method["parameters"]) if method else 0)
        self.tokens = np.array(tokens, np.int64).reshape(-1, 11)
        self.spans = np.array(spans, np.int64).reshape(-1, 4)
        self.kinds, self.counts = np.array(kinds, np.int8), np.array(counts, np.int32)
        self.at_token, self.params = np.array(at_token, np.int64).reshape(-1, 5), np.array(params, np.int64).reshape(-1, 5)


MARKS = _Open()


class Shapes:
    """Plans of the shapes that a worker has met twice, bounded by their texts' length."""

    def __init__(self):
        self.plans: dict[str, Plan | None] = {}
        self.met: set[int] = set()
        self.kept = 0

    def plan(self, text: str, parse) -> tuple[Plan | None, list[str]]:
        """The plan by which to read a text, and its pieces; None if it is to be parsed by itself. parse: gives a file that plans."""
        if len(text) > LONGEST or WHOLE.search(text):
            return None, []
        pieces = RUN.split(text)
        shape = pieces.copy()
        shape[1::2] = map(MARKS.__getitem__, pieces[1::2])
        key = "".join(shape)
        try:
            return self.plans[key], pieces
        except KeyError:
            pass
        if (digest := hash(key)) not in self.met:
            if len(self.met) > 1 << 20:
                self.met.clear()
            self.met.add(digest)
            return None, []
        try:
            plan = Plan(parse(), pieces)
        except Unshared:
            plan = None
        if self.kept > KEPT:
            self.plans.clear()
            self.kept = 0
        self.plans[key] = plan
        self.kept += len(key) + 2000
        return plan, pieces


def _decoded(parts: list[str]) -> list[str]:
    return [x if x.isascii() else x.encode("latin-1").decode("utf-8", "replace") for x in parts]


def rows(files: list[tuple[str, str, Plan, list[str]]], name_of, normal) -> pa.RecordBatch | None:
    """Surfaces of files (path, text, plan, pieces). name_of: path and what is named by imports to the component's name, if any; normal: bytes with their white space made plain."""
    named = []
    for path, text, plan, pieces in files:
        if not plan.rows and not plan.names:
            continue
        begins = [0, *accumulate(map(len, pieces))] if plan.names else ()
        imports = _decoded([text[begins[a] + b : begins[c] + d] for a, b, c, d in plan.names])
        name = name_of(path, imports)
        if name:
            named.append((path, text, plan, pieces, name))
    if not named:
        return None
    schema = to_arrow_schema(EXTRACTED)
    plans = [x[2] for x in named]
    whole = "".join([x[1] for x in named])
    lengths: list[int] = []
    first = []
    for x in named:
        first.append(len(lengths))
        lengths.extend(map(len, x[3]))
    begins = np.concatenate([[0], np.cumsum(np.array(lengths, np.int64))])
    first = np.array(first, np.int64)
    each = np.array([len(p.tokens) for p in plans], np.int64)
    piece, zero = np.repeat(first, each), np.repeat(begins[first], each)
    t = np.concatenate([p.tokens for p in plans])
    place = lambda i: begins[t[:, i] + piece] + t[:, i + 1]
    start, end = place(0), place(2)
    texts = _decoded([whole[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    for i in np.flatnonzero(t[:, 10]).tolist():
        texts[i] = normal(whole[start[i] : end[i]].encode("latin-1")).decode("utf-8", "replace")
    token_type = schema.field("source_token").type
    range_type = token_type.field("source_range").type
    point_type = range_type.field("start_point").type
    point = lambda row, column: pa.StructArray.from_arrays([pa.array(row), pa.array(column)], fields=list(point_type))
    ranges = pa.StructArray.from_arrays([pa.array(start - zero), pa.array(end - zero), point(t[:, 4], start - place(6)), point(t[:, 5], end - place(8))], fields=list(range_type))
    tokens = pa.StructArray.from_arrays([pa.array(texts, pa.string()), ranges], fields=list(token_type))

    base = np.concatenate([[0], np.cumsum(each)[:-1]])
    n_rows = np.array([p.rows for p in plans], np.int64)

    def taken(index: np.ndarray, n: np.ndarray) -> list[pa.Array]:
        shift = np.repeat(base, n)
        return [tokens.take(pa.array(np.where(c < 0, 0, c + shift), mask=c < 0)) for c in index.T]

    of_row = taken(np.concatenate([p.at_token for p in plans]), n_rows)
    of_param = taken(np.concatenate([p.params for p in plans]), np.array([len(p.params) for p in plans], np.int64))
    kinds = np.concatenate([p.kinds for p in plans])
    signature_type = schema.field("signature").type
    method_type, prop_type = signature_type.field("ts_method").type, signature_type.field("vue_prop").type
    list_type = method_type.field("parameters").type
    params = pa.StructArray.from_arrays(of_param, fields=list(list_type.value_type))
    offsets = np.concatenate([[0], np.cumsum(np.concatenate([p.counts for p in plans]))]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), params, type=list_type)
    method = pa.StructArray.from_arrays([of_row[1], lists, of_row[2]], fields=list(method_type), mask=pa.array(kinds != 1))
    prop = pa.StructArray.from_arrays(of_row[3:5], fields=list(prop_type), mask=pa.array(kinds != 2))
    signature = pa.StructArray.from_arrays([pa.array(KINDS).take(pa.array(kinds)), method, prop], fields=list(signature_type))

    s, by_row = np.concatenate([p.spans for p in plans]), np.repeat(first, n_rows)
    ends = zip((begins[s[:, 0] + by_row] + s[:, 1]).tolist(), (begins[s[:, 2] + by_row] + s[:, 3]).tolist(), strict=True)
    own = iter(_decoded([whole[a:b] for a, b in ends]))
    fqns = [f"vue.{x[4]}{kind}{text}" if kind else f"vue.{x[4]}" for x in named for kind, text in zip(x[2].members, own)]  # noqa: B905  own goes on with the next file
    paths = pa.array([x[0] for x in named]).take(pa.array(np.repeat(np.arange(len(named)), n_rows)))
    seq = np.arange(len(kinds)) - np.repeat(np.cumsum(n_rows) - n_rows, n_rows)
    return pa.RecordBatch.from_arrays([paths, of_row[0], pa.array(fqns, pa.string()), signature, pa.array(seq)], schema=schema)
