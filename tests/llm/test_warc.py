import base64
import gzip
import hashlib
import io
import zlib

import pytest

from tessel.llm import warc
from tessel.llm.common import shared_dir


def pages(spark, *rows):
    return spark.createDataFrame([(*r, "k", "x") for r in rows], "page_id long, url string, html string, key string, path string")


def sha(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def brute(rows):
    best = {}
    for i, _, h in rows:
        h = (h or "").encode()
        best[h] = max(best.get(h, -1), -1 if i is None else i)
    out = []
    for i, _, h in rows:
        h = (h or "").encode()
        first = i == best[h] or best[h] == -1
        out.append((i, len(h), sha(h), "response" if first else "revisit", None if first else best[h]))
    return sorted(out, key=repr)


ROWS = [(1, "http://a/é?x=1", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u\r\nWARC-Type: evil", ""), (4, "u", None), (5, "u", "x" * 3_000_000), (6, "u", "\r\n\r\nWARC/1.1\r\n"), (6, "u", "\r\n\r\nWARC/1.1\r\n"), (None, "u", "<p>é</p>")]


def test_round_trip(spark, rows):
    assert rows(warc.round_trip(pages(spark, *ROWS))) == brute(ROWS)
    assert rows(warc.round_trip(pages(spark, (None, "u", "q"), (None, "u", "q")))) == brute([(None, "u", "q")] * 2)
    assert rows(warc.round_trip(pages(spark, *ROWS).where("false"))) == []


def test_hot_payload_and_rolling(spark, rows):
    many = [(i, "u", "same" if i % 3 else str(i)) for i in range(300)]
    df = pages(spark, *many).repartition(3)
    folder = shared_dir(spark) + "/warc-roll"
    manifest = warc.write(df, folder, roll=2000)
    assert manifest.count() > 10
    got = warc.read(spark, manifest, folder)
    assert sorted(r["record_id"].rpartition(":")[0] for r in got.collect()) == sorted(f"urn:page:{i}" for i, *_ in many)
    ids = {r["record_id"] for r in got.where("record_type = 'response'").collect()}
    assert len(ids) == 101 and {r["refers_to"] for r in got.where("record_type = 'revisit'").collect()} <= ids
    assert {r["record_type"]: r["n"] for r in got.groupBy("record_type").count().withColumnRenamed("count", "n").collect()} == {"response": 101, "revisit": 199}
    assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in got.collect())


def test_members_are_plain_gzip(spark):
    data = warc.page_record("urn:page:1", "http://a", b"hello", None) + warc.page_record("urn:page:2", None, b"hello", "urn:page:1")
    text = gzip.decompress(data).decode()
    assert text.count("WARC/1.1\r\n") == 2 and text.endswith("\r\n\r\n\r\n\r\n") and f"sha1:{sha(b'hello')}" in text
    assert len(list(warc.records(io.BytesIO(data)))) == 2
    assert gzip.decompress(data[: data.index(b"\x1f\x8b", 2)]).count(b"WARC/1.1\r\n") == 1  # a member a record
    first, second = warc.pages_of(io.BytesIO(data))
    assert first == ("response", "urn:page:1", "http://a", None, sha(b"hello"), 5, b"hello")
    assert second == ("revisit", "urn:page:2", None, "urn:page:1", sha(b"hello"), 5, None)


def foreign(kind, block, *fields, end=b"\r\n\r\n"):
    head = [("WARC-Type", kind), ("WARC-Record-ID", "<urn:x>"), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + end


HTTP = ("Content-Type", "application/http; msgtype=response")


def test_archives_from_elsewhere():
    raw = [
        foreign("warcinfo", b"software: x\r\n", ("Content-Type", "application/warc-fields")),
        foreign("response", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody", HTTP),  # neither digests nor an HTTP length
        foreign("response", b"HTTP/1.0 200\n\nline ends", HTTP, ("WARC-Target-URI", "u"), ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(b"line ends").hexdigest())),
        foreign("response", b"plain", ("Content-Type", "text/dns"), ("WARC-Block-Digest", "md5:" + hashlib.md5(b"plain").hexdigest()), ("X-Folded", "a\r\n b")),
        foreign("revisit", b"", ("WARC-Refers-To", "<urn:y>"), ("WARC-Payload-Digest", "sha1:ABC")),
        foreign("response", b"HTTP/1.1 204 No\r\nX: y", HTTP, ("WARC-Payload-Digest", "blake9:zz")),
        foreign("response", b"HTTP/1.1 200\r\nTransfer-Encoding: chunked\r\n\r\n2\r\nab\r\n0\r\n\r\n", HTTP, ("WARC-Payload-Digest", "sha1:" + sha(b"ab")), end=b"\r\n\r\n\r\n"),
    ]
    want = [("response", None, sha(b"body"), 4, b"body"), ("response", "u", sha(b"line ends"), 9, b"line ends"), ("response", None, sha(b"plain"), 5, b"plain"), ("revisit", None, "ABC", None, None), ("response", None, sha(b""), 0, b""), ("response", None, "", 12, None)]
    z = lambda data: gzip.compress(data)
    for data in (b"".join(raw), z(b"".join(raw)), b"".join(map(z, raw)), z(raw[0] + raw[1]) + z(b"".join(raw[2:]))):
        for stream in (io.BytesIO(data), Slow(data)):
            got = [(x[0], x[2], x[4], x[5], x[6]) for x in warc.pages_of(stream)]
            assert got[:5] == want[:5] and got[5][4] == b"2\r\nab\r\n0\r\n\r\n"
        assert [x[5] for x in warc.pages_of(io.BytesIO(data), payloads=False)] == [4, 9, 5, None, 0, 12]
    assert list(warc.records(io.BytesIO(b""))) == []
    for bad in (foreign("response", b"x", ("WARC-Block-Digest", "sha1:AAAA")), b"WARC/1.0\r\nWARC-Type: x\r\n\r\n", foreign("response", b"xy")[:-6], b"WARC/1.0\r\nA: b", b"junk\r\n\r\n"):
        with pytest.raises(warc.WarcError):
            list(warc.records(io.BytesIO(bad)))


class Slow(io.BytesIO):
    def read(self, n=-1):
        return super().read(7)


def test_reads_bit_by_bit():
    data = b"".join(warc.page_record(f"urn:page:{i}", "u", bytes([i]) * i * 50, None) for i in range(20))
    assert [x[5] for x in warc.pages_of(Slow(data))] == [i * 50 for i in range(20)]


def broken(change):
    raw = zlib.decompress(warc.page_record("urn:page:1", "u", b"hello", None), 31)
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(change(raw)) + z.flush()


@pytest.mark.parametrize(
    "data",
    [
        warc.page_record("urn:page:1", "u", b"hello", None)[:-9],
        broken(lambda r: r.replace(b"hello", b"jello")),
        broken(lambda r: r[:-1]),
        broken(lambda r: r.replace(b"WARC/1.1", b"WORC/1.1")),
        broken(lambda r: r.replace(sha(b"hello").encode(), sha(b"other").encode())),
    ],
)
def test_damage_raises(data):
    with pytest.raises(warc.WarcError):
        list(warc.pages_of(io.BytesIO(data)))


def test_archives_in_a_store_that_only_spark_opens(spark, rows, tmp_path):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.archives.link./in", f"file://{tmp_path}")
    data = pages(spark, (1, "u", "<p>é</p>"), (2, "v", "x" * 300), (3, None, "x" * 300))
    manifest = warc.write(data, f"file://{tmp_path}", roll=100)
    both = [rows(warc.read(spark, manifest, folder)) for folder in (f"file://{tmp_path}", "viewfs://archives/in")]
    assert both[0] == both[1] and len(both[0]) == 3


def test_hadoop_names_of_stores():
    for name, uri in (("s3a", "s3"), ("gcs", "gs"), ("file", "file"), ("hdfs", "hdfs")):
        assert warc.ALIASES.get(name, name) == uri


def test_only_the_records_are_left(spark):
    from test_pipeline import tables

    before = tables(spark)
    out = warc.round_trip(pages(spark, (1, "u", "a"), (2, "v", "a")))
    assert [n.split("-")[0] for n in tables(spark) - before] == ["records"] and out.count() == 2
