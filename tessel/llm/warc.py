"""WARC archives: writing with payload deduplication, and a sequential reader.

Every record is one gzip member. The reader takes an archive as a stream: it inflates it bit by bit, frames each record by
its content length while it inflates, and verifies the digests of block and payload that are stated; a broken frame or
digest raises. It reads archives from elsewhere as well: without digests or with others than SHA-1, with several records
in a member or none in gzip, and records that aren't HTTP messages. Only a payload that is asked for is held as a whole.

A record's id has the page's and a part of its payload's digest, so only rows that are repeated in full share one.

Archives are written by the executors through pyarrow's file systems into the shared folder. A task that is run again
writes new files; only those named in the committed manifest are read.

Defined results: null html is an empty payload; of equal payloads the rows with the largest page_id are responses and
the others revisit them; if all their ids are null all are responses; rows repeated in full are records of their own;
null urls give records without a target; an empty table gives no records; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, drop, map_arrow, scratch, shared_dir, table
from .texts import small

DATE = "1970-01-01T00:00:00Z"
ROLL = 64 << 20  # an archive is closed at this size
CHUNK = 1 << 18
MOST_HEAD = 1 << 20  # bytes of a header
EMPTY_LINE = re.compile(rb"\r?\n\r?\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Hadoop's names of stores that Arrow calls otherwise
ALIASES = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}
RECORDS = "record_type string, record_id string, target string, refers_to string, payload_digest string, payload_bytes long, payload binary"


class WarcError(ValueError):
    """A record that isn't framed or digested as it says."""


def digest(data: bytes) -> str:
    """Upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, block: bytes, fields: Iterable[tuple[str, str]] = ()) -> bytes:
    """One record as one gzip member."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), *fields, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))]
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def page_record(record_id: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """A response with its payload or, if it refers to another, a revisit with the headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [] if url is None else [("WARC-Target-URI", quote(url, safe="%/:?#[]@!$&'()*+,;=~"))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if refers_to is None:
        return record("response", record_id, http + payload, fields)
    return record("revisit", record_id, http, [*fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>")])


class Inflated:
    """The bytes that a stream of gzip members (or of plain bytes) holds, in order, a bounded piece at a time."""

    def __init__(self, stream):
        self.stream, self.z, self.raw, self.held = stream, None, b"", b""
        self.plain = None

    def _more(self) -> bool:
        """Hold some more bytes; False at the end of the last member."""
        while True:
            if not self.raw:
                self.raw = self.stream.read(CHUNK)
                if not self.raw:
                    if self.z is not None:
                        raise WarcError("the archive ends within a record")
                    return False
            if self.plain is None:
                while len(self.raw) < 2 and (data := self.stream.read(CHUNK)):
                    self.raw += data
                self.plain = self.raw[:2] != b"\x1f\x8b"
            if self.plain:
                out, self.raw = self.raw, b""
            else:
                self.z = self.z or zlib.decompressobj(31)
                try:
                    out = self.z.decompress(self.raw, CHUNK)
                except zlib.error as e:
                    raise WarcError(f"a member can't be inflated: {e}") from e
                self.raw = self.z.unconsumed_tail
                if self.z.eof:
                    self.raw, self.z = self.z.unused_data, None
                elif not out and not self.raw:
                    continue
            if out:
                self.held += out
                return True

    def head(self) -> bytes | None:
        """What comes before the next empty line, which is passed over; None at the end."""
        while True:
            if self.held:
                m = EMPTY_LINE.search(self.held)
                if m:
                    out, self.held = self.held[: m.start()], self.held[m.end() :]
                    return out
                if len(self.held) > MOST_HEAD:
                    raise WarcError("a header doesn't end")
            if not self._more():
                if self.held:
                    raise WarcError("the archive ends within a header")
                return None

    def line_ends(self) -> int:
        """How many line ends come next; they are passed over."""
        n = 0
        while self.held or self._more():
            rest = self.held.lstrip(b"\r\n")
            n += self.held[: len(self.held) - len(rest)].count(b"\n")
            self.held = rest
            if rest:
                break
        return n

    def block(self, n: int) -> Iterator[bytes]:
        """The next n bytes in pieces."""
        while n:
            if not self.held and not self._more():
                raise WarcError("the archive ends within a block")
            part, self.held = self.held[:n], self.held[n:]
            n -= len(part)
            yield part


def named(head: bytes) -> dict[str, str]:
    """The fields of a header by lower-cased names; folded lines are joined."""
    lines: list[str] = []
    for line in head.decode("utf-8", "replace").splitlines()[1:]:
        if line[:1] in (" ", "\t") and lines:
            lines[-1] += " " + line.strip()
        else:
            lines.append(line)
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


class Check:
    """A digest as a field states it; ``sha1`` is taken in any case."""

    def __init__(self, said: str | None):
        name, _, self.value = (said or "").partition(":")
        name = name.strip().lower().replace("-", "")
        self.known = name in ("md5", "sha1", "sha256", "sha512")
        self.sha1 = hashlib.sha1()
        self.hash = self.sha1 if name == "sha1" or not self.known else hashlib.new(name)
        self.said_sha1 = self.value.strip() if name == "sha1" else None

    def update(self, data: bytes) -> None:
        self.sha1.update(data)
        if self.hash is not self.sha1:
            self.hash.update(data)

    def wrong(self) -> bool:
        """Whether a known digest is stated and isn't this one, in base32 or hex."""
        d, value = self.hash.digest(), self.value.strip()
        return self.known and value.rstrip("=").upper() != base64.b32encode(d).decode().rstrip("=") and value.lower() != d.hex()


def records(stream, payloads: bool = True) -> Iterator[tuple]:
    """(record_type, record_id, target, refers_to, payload_digest, payload_bytes, payload) of every record.

    Blocks are read in pieces; what follows the headers of an HTTP message is the payload, else the whole block. Stated
    digests are verified, but that of a payload only where it is whole and as it was sent. A revisit has the digest and
    the length that it states, if it does; other records have those of their payload.
    """
    bare = lambda x: None if x is None else x.strip("<>")
    source = Inflated(stream)
    while (head := source.head()) is not None:
        if not head.startswith(b"WARC/"):
            raise WarcError("no WARC header")
        f = named(head)
        name, length = f.get("warc-record-id"), f.get("content-length", "")
        if not length.isdigit():
            raise WarcError(f"{name}: no content length")
        whole, payload = Check(f.get("warc-block-digest")), Check(f.get("warc-payload-digest"))
        http = f.get("content-type", "").lower().startswith("application/http")
        lead, parts, size = b"" if http else None, [], 0
        for part in source.block(int(length)):
            whole.update(part)
            if lead is not None:
                lead += part
                m = EMPTY_LINE.search(lead)
                if m is None:
                    continue
                part, lead_end = lead[m.end() :], lead[: m.start()]
                fields, lead = named(lead_end), None
            payload.update(part)
            size += len(part)
            if payloads:
                parts.append(part)
        if source.line_ends() < 2:
            raise WarcError(f"{name}: the block isn't as long as it says")
        if lead is not None:  # headers only, without an empty line
            fields = named(lead)
        if whole.wrong():
            raise WarcError(f"{name}: wrong block digest")
        kind, said = f.get("warc-type", "").lower(), None
        if kind == "revisit":
            said = fields.get("content-length", "") if http else ""
            size, digest_ = int(said) if said.isdigit() else None, payload.said_sha1
        else:
            if payload.wrong() and "warc-truncated" not in f and "chunked" not in (fields.get("transfer-encoding", "") if http else ""):
                raise WarcError(f"{name}: wrong payload digest")
            digest_ = base64.b32encode(payload.sha1.digest()).decode()
        yield kind, bare(name), f.get("warc-target-uri"), bare(f.get("warc-refers-to")), digest_, size, b"".join(parts) if payloads and kind != "revisit" else None


def pages_of(stream, payloads: bool = True) -> Iterator[tuple]:
    """The responses and revisits among the records."""
    return (r for r in records(stream, payloads) if r[0] in ("response", "revisit"))


def _files(folder: str):
    """Arrow's file system for a folder by its Hadoop name, and the path in it."""
    from pyarrow import fs

    scheme, mark, rest = folder.partition("://")
    return fs.FileSystem.from_uri(f"{ALIASES.get(scheme, scheme)}{mark}{rest}")


def _writer(folder: str, name: str, roll: int):
    """Rows (page_id, url, html, response_id) to archives; rows (path, bytes, records)."""
    urn = lambda i, data: f"urn:{name}:{'' if i is None else i}:{hashlib.sha256(data).hexdigest()[:16]}"

    def run(batches):
        system, root = _files(folder)
        out = path = None
        size = count = 0
        done = []
        try:
            for b in batches:
                for i, url, html, to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "response_id")), strict=True):
                    if out is None:
                        path = f"{uuid.uuid4().hex}.warc.gz"
                        out, size, count = system.open_output_stream(f"{root}/{path}", compression=None), 0, 0
                        size += out.write(record("warcinfo", f"urn:uuid:{uuid.uuid4()}", b"format: WARC File Format 1.1\r\n", [("Content-Type", "application/warc-fields")])) or 0
                    raw = (html or "").encode()
                    data = page_record(urn(i, raw), url, raw, None if to is None else urn(to, raw))
                    out.write(data)
                    size, count = size + len(data), count + 1
                    if size >= roll:
                        out.close()
                        out = None
                        done.append((path, size, count))
        finally:
            if out is not None:
                out.close()
                done.append((path, size, count))
        cols = list(zip(*done, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["path", "bytes", "records"])

    return run


def _batches(streams, payloads: bool) -> Iterator[pa.RecordBatch]:
    """The records of archives, each read in sequence."""
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def batch(rows):
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    for stream in streams:
        rows, size = [], 0
        with stream:
            for x in pages_of(stream, payloads):
                rows.append(x)
                size += len(x[6] or b"")
                if len(rows) >= 2000 or size >= 8 << 20:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)


def _reader(folder: str, payloads: bool):
    def run(batches):
        system, root = _files(folder)
        yield from _batches((system.open_input_stream(f"{root}/{path}", compression=None) for b in batches for path in b.column("path").to_pylist()), payloads)

    return run


def _parser(payloads: bool):
    def run(batches):
        yield from _batches((io.BytesIO(x.as_buffer()) for b in batches for x in b.column("content")), payloads)

    return run


def write(pages: DataFrame, folder: str, least: int = 0, name: str = "page", roll: int = ROLL, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for every page into archives in folder; the manifest (path, bytes, records). Payloads under ``least`` bytes are never revisits."""
    id_, html = column(pages, id_col), F.coalesce(column(pages, html_col), F.lit(""))
    key = F.sha2(html, 256)
    rows = pages.select(id_.cast("long").alias("page_id"), column(pages, url_col).alias("url"), html.alias("html"), key.alias("key"))
    again = rows.where(F.octet_length("html") >= least).groupBy("key").agg(F.count("*").alias("n"), F.max("page_id").alias("largest")).where("n > 1").select("key", "largest")
    again, _ = table(again, "payloads")
    rows = rows.join(small(again), "key", "left")
    to = F.when(F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest"))
    spark = pages.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return table(map_arrow(rows.select("page_id", "url", "html", to.alias("response_id")), _writer(folder, name, roll), "path string, bytes long, records long"), "manifest")[0]


def read(spark: SparkSession, manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The responses and revisits in the manifest's archives, archives in parallel, each in sequence; by Spark's reader of binary files where Arrow can't open the folder."""
    n = max(1, manifest.count())
    names = manifest.select("path").repartition(n)
    try:
        _files(folder)
    except (OSError, pa.ArrowException):  # a store that only Spark opens: archives are rows, which their size bounds
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
        found = found.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(names.withColumnRenamed("path", "name"), "name", "left_semi")
        return map_arrow(found.select("content"), _parser(payloads), RECORDS)
    return map_arrow(names, _reader(folder, payloads), RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read back from archives of the pages."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/tessel/warc-{uuid.uuid4().hex}"
    with scratch(spark) as made:
        got, path = table(read(spark, write(pages, folder), folder, payloads=False), "records")
        made.remove(path)
    drop(spark, folder)
    number = lambda c: F.expr(f"cast(nullif(split_part({c}, ':', 3), '') as long)")  # noqa: E731  urn:page:id:digest
    return got.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
