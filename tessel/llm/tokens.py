"""Token-ID output in ORC and reading it back.

Whole texts are ordered by id across range partitions, encoded, and written as ORC: ids are integer run-length encoded,
every stripe has row indexes, and document ids have Bloom filters, so a reader can take stripes in parallel and skip
those that lack an id. ``read`` gives the documents back; ``positions`` adds what only the files tell.

Words recur: where white space always ends a token, which probes of the tokenizer tell, each worker encodes the distinct
words of a batch of texts and keeps ids of their parts, up to a bound; the ids are those of the whole text. Any other
tokenizer gets whole texts.

Defined results: a null text is empty and has the end id only; rows with equal ids keep an order that the files fix;
null ids come first; an empty table gives empty files and no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, map_arrow, small_batches, table

TO_LOWER = bytes(range(256)).lower()
#: Letters that need no normalising (a-z and those of Latin-1), and ASCII punctuation after them.
SHAPE = r"^(?P<core>[a-zß-öø-ÿ]+)(?P<tail>[!-/:-@\[-`{-~]*)$"
CACHED_PIECES = 500_000
TEXTS, BYTES = 1000, 8 << 20  # encoded together
#: What tells that a tokenizer keeps apart what white space separates: words, and white space around and between them.
PROBES = ("the", "quick", "naïve", "DON'T", "x1", "'s", "(42)"), (" ", "  ", "\t", "\n ", "\r\n\n", "\x0b\x0c")
_coders: dict[str, Coder] = {}


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions starts[i] to starts[i] + sizes[i], of all i in turn."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Pieces:
    """Ids of strings, in one array; forgets all beyond ``limit`` strings."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self):
        self.at: dict[str, int] = {}
        self.spans, self.ids, self.size = np.zeros((1024, 2), np.int64), np.zeros(4096, "<u4"), 0

    def add(self, strings: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        """strings[i] has the ids from ends[i - 1] to ends[i]."""
        n, to = len(self.at), self.size + len(ids)
        while len(self.spans) < n + len(strings):
            self.spans = np.concatenate([self.spans, np.zeros_like(self.spans)])
        while len(self.ids) < to:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.size : to] = ids
        self.spans[n : n + len(strings), 0] = self.size + np.concatenate([[0], ends[:-1]])
        self.spans[n : n + len(strings), 1] = np.diff(ends, prepend=0)
        self.at.update(zip(strings, range(n, n + len(strings)), strict=True))
        self.size = to


class Coder:
    """Whole texts to ids; bounded memory.

    A tokenizer that never joins over white space gets each distinct word of a batch once, and of most words, which
    are letters and then punctuation, the two parts, as far as it hasn't met them before. Where it marks the ends of
    words, letters go through a copy of it that leaves out the normalising that they don't need. Any other tokenizer
    gets whole texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.full, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.full.get_vocab(with_added_tokens=True)
        suffix = getattr(self.full.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.pieces = Pieces(CACHED_PIECES)
        whole = lambda t: self.full.encode(t, add_special_tokens=False).ids
        words, blanks = PROBES
        #: whether words can be encoded one by one
        self.apart = bool(suffix) and all(whole(f"{s}{a}{s}{b}{s}") == whole(a) + whole(b) for a in words for b in words for s in blanks)
        probe = ["the", "quick", "naïve", "zÿß", "x"]
        #: whether letters can, without normalising
        self.simple = False
        if self.apart and self._letters(probe):
            known = {w: self.pieces.ids[a : a + n].tolist() for w, (a, n) in ((w, self.pieces.spans[i]) for w, i in self.pieces.at.items())}
            self.simple = all(whole(f"{w.upper()}, {w}!?)") == known[w] + whole(",") + known[w] + whole("!?)") for w in probe if w.isascii())
            self.simple &= all(whole(w) == known[w] for w in probe)
        self.pieces.clear()

    def _letters(self, some: list[str]) -> bool:
        """Encode words of lower-case letters, unless the ids don't show where words end."""
        ids = np.array(self.plain.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(some):
            return False
        self.pieces.add(some, ids, cuts)
        return True

    def _others(self, some: list[str]) -> bool:
        """Encode any words; offsets tell which ids are whose."""
        got = self.full.encode(" ".join(some), add_special_tokens=False)
        starts = np.fromiter(map(itemgetter(0), got.offsets), np.int64, len(got))
        self.pieces.add(some, np.array(got.ids, "<u4"), np.searchsorted(starts, np.cumsum([len(w) + 1 for w in some])))
        return True

    def _numbers(self, strings: pa.Array, encode) -> np.ndarray:
        """The pieces' numbers of distinct strings; new ones are encoded."""
        strings = strings.to_pylist()
        found = list(map(self.pieces.at.get, strings))
        new = [w for w, i in zip(strings, found, strict=True) if i is None]
        if new:
            at = iter(range(len(self.pieces.at), len(self.pieces.at) + len(new)))
            for i in range(0, len(new), 4096):
                part = new[i : i + 4096]
                encode(part) or self._others(part)
            found = [next(at) if i is None else i for i in found]
        return np.array(found, np.int64)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words, and where each word's start and how many they are."""
        if len(self.pieces.at) > self.pieces.limit:
            self.pieces.clear()
        # a word is a first piece and maybe a second
        first, second = np.full(len(words), -1), np.full(len(words), -1)
        rest = words
        if self.simple:
            parts = pc.extract_regex(words, SHAPE)
            made = parts.is_valid().to_numpy(zero_copy_only=False)
            rest = words.filter(pa.array(~made))
            for name, to, encode in (("core", first, self._letters), ("tail", second, self._others)):
                some = pc.struct_field(parts.filter(pa.array(made)), name).dictionary_encode()
                to[made] = self._numbers(some.dictionary, encode)[some.indices.to_numpy()]
            first[~made] = self._numbers(rest, self._others)
        else:
            first[:] = self._numbers(rest, self._others)
        spans = self.pieces.spans[np.stack([first, second], axis=1)]
        spans[second < 0, 1, 1] = 0
        sizes = spans[:, :, 1].sum(axis=1)
        return self.pieces.ids[ragged(spans[:, :, 0].ravel(), spans[:, :, 1].ravel())], np.cumsum(sizes) - sizes, sizes

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts as unsigned 32-bit integers, and how many each has."""
        if not self.apart:
            got = [x.ids for x in self.full.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(got), "<u4"), np.array([len(x) for x in got], np.int64)
        split = pc.ascii_split_whitespace(pa.array([self.lowered(x.as_buffer().to_pybytes()) for x in texts.cast(pa.large_binary())], pa.large_binary()).cast(pa.large_string()))
        words = split.flatten().dictionary_encode()
        ids, starts, sizes = self._words(words.dictionary)
        at = words.indices.to_numpy()
        each = sizes[at]
        ends = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])]
        return ids[ragged(starts[at], each)], np.diff(ends)

    def lowered(self, data: bytes) -> bytes:
        """A-Z lower-cased where that can't matter: no combining marks, no special tokens."""
        return data.translate(TO_LOWER) if self.simple and not (b"\xcc" in data or b"\xcd" in data or b"<|" in data) else data


def coder(path: str) -> Coder:
    """This process's coder: what tasks call by name keeps its pieces from one task to the next."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def _parts(texts: pa.Array):
    """(start, number) of neighbouring texts that are encoded together."""
    sizes, at = pc.fill_null(pc.binary_length(texts), 0).to_numpy(), 0
    while at < len(sizes):
        n = min(int(np.searchsorted(np.cumsum(sizes[at : at + TEXTS]), BYTES)) + 1, TEXTS, len(sizes) - at)
        yield at, n
        at += n


def _encode(path: str, end: int):
    def run(batches):
        encode = coder(path)
        for b in batches:
            texts = pc.fill_null(b.column("text"), "")
            for at, n in _parts(texts):
                ids, sizes = encode(texts.slice(at, n))
                ends = np.cumsum(sizes)
                values = np.insert(ids, ends, end).astype(np.int32)
                offsets = np.concatenate([[0], ends + np.arange(1, n + 1)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, n), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["doc_id", "ids"])

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text", stride: int = 10_000) -> None:
    """Write docs' ids as ORC at path, in ascending order of their id: (doc_id, pos, ids); pos orders all rows."""
    text, id_ = column(docs, text_col), column(docs, id_col)
    rows = docs.select(id_.cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    # the digest splits ranges where ids are equal
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    coded = map_arrow(rows, _encode(tokenizer, end), "doc_id long, ids array<int>")
    options = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": str(stride)}
    with small_batches(docs.sparkSession):
        coded.select("doc_id", F.monotonically_increasing_id().alias("pos"), "ids").write.options(**options).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, pos, ids) from the files; filters on doc_id are pushed to stripes' statistics and Bloom filters."""
    return spark.read.schema("doc_id long, pos long, ids array<int>").orc(path)


def _sums(batches):
    for b in batches:
        ids = b.column("ids")
        flat, at = ids.values.to_numpy().astype("<u4"), ids.offsets.to_numpy()
        crc = [zlib.crc32(flat[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("pos"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "pos", "n_tokens", "ids_crc32"])


def positions(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document read: start counts all ids before it."""
    rows = map_arrow(files, _sums, "doc_id long, pos long, n_tokens long, ids_crc32 long")
    rows, _ = table(rows.withColumn("part", F.shiftright("pos", 33)), "token-rows")
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each file
    run = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("pos")) - F.col("n_tokens")
    return rows.withColumn("run", run).join(parts, "part").select("doc_id", (F.col("before") + F.col("run")).alias("start"), "n_tokens", "ids_crc32")
