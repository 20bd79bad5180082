import base64
import gzip
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import warc
from quillgraph.session import fresh_path

ODD = ["", None, "a", "a\r", "a\r\n", "\r\n\r\n", "\n", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "é日\U0001f600", "\r\r\n\n\r", "z" * 3_000_000, "a", "a", ""]


def sha(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_round_trip_of_any_payload(spark):
    rows = [(i, f"http://h/{i}", t) for i, t in enumerate(ODD)]
    path = fresh_path(spark, "warc")
    warc.write_captures(spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(0) for c in ("id", "digest", "file", "first")}), path, least=1, per_file=3)
    got = {r.capture_id: r for r in warc.assemble(warc.read_archives(spark, path)).collect()}
    assert len(got) == len(ODD)
    first = {}
    for r in got.values():
        i = int(r.metadata[0].payload.split()[1])
        want = (ODD[i] or "").encode()
        earlier = min(j for j, t in enumerate(ODD) if (t or "").encode() == want) if want else i
        assert r.target_uri == f"http://h/{i}" and len(r.requests) == len(r.metadata) == 1
        assert r.main.type == ("response" if earlier == i else "revisit") and r.main.payload_digest == sha(want)
        if r.main.type == "response":
            assert bytes(r.main.payload) == want and r.main.computed_digest == sha(want)
            first[i] = r.capture_id
        else:
            assert r.main.payload_bytes == 0 and r.main.http_length == len(want)
    for r in got.values():
        if r.main.type == "revisit":
            assert r.main.refers_to in first.values()


def test_binary_bodies_and_repeated_rows(spark):
    rows = [(None, None, bytearray(range(256))), (7, "u\r\nX: y", bytearray(range(256))), (7, "u\r\nX: y", bytearray(range(256))), (3, "v", bytearray(b"\xff\r\xfe"))]
    path = fresh_path(spark, "warc")
    warc.write_captures(spark.createDataFrame(rows, "page_id int, url string, html binary"), path)
    got = warc.assemble(warc.read_archives(spark, path)).collect()
    assert sorted(r.main.type for r in got) == ["response", "response", "revisit", "revisit"]
    assert {bytes(r.main.payload) for r in got if r.main.type == "response"} == {bytes(range(256)), b"\xff\r\xfe"}
    keyed = {bytes(r.metadata[0].payload): r.main.type for r in got if r.main.type == "response"}
    assert set(keyed) == {b"key: 7\r\n", b"key: 3\r\n"}
    assert {r.target_uri for r in got} == {"", "u__X: y", "v"}


def archive(folder: Path, name: str, *records: tuple[str, str]) -> None:
    text = b"".join(b"WARC/1.0\r\n" + h.encode() + f"Content-Length: {len(b)}\r\n\r\n".encode() + b.encode() + b"\r\n\r\n" for h, b in records)
    # A gzip member for each record, as crawlers write them.
    (folder / name).write_bytes(b"".join(gzip.compress(p) for p in (text[:50], text[50:])))


def test_assembly_of_foreign_archives(spark, tmp_path):
    head = lambda kind, ident, *to: f"WARC-Type: {kind}\r\nWARC-Record-ID: <{ident}>\r\n" + "".join(f"WARC-Concurrent-To: <{t}>\r\n" for t in to)
    archive(
        tmp_path, "a.warc.gz",
        ("WARC-Type: warcinfo\r\nWARC-Record-ID: <i>\r\n", "software: x\r\n"),
        (head("response", "r1"), "HTTP/1.1 200 OK\r\n\r\nbody"),
        (head("request", "q1", "r1", "gone"), "GET"),
        (head("metadata", "m1", "q1"), "hop"),
        (head("request", "q2"), "named by its response"),
        (head("response", "r2", "q2"), "no header end"),
    )
    archive(tmp_path, "b.warc.gz", (head("metadata", "m2", "r1"), "other file"), (head("metadata", "m3", "nobody"), ""), (head("resource", "s1"), "raw"))
    got = {r.capture_id: r for r in warc.assemble(warc.read_archives(spark, str(tmp_path))).collect()}
    assert set(got) == {"r1", "r2", "s1", "m3"}
    assert bytes(got["r1"].main.payload) == b"body" and {m.record_id for m in got["r1"].metadata} == {"m1", "m2"}
    assert [q.record_id for q in got["r2"].requests] == ["q2"] and got["m3"].main is None and got["s1"].main.payload == bytearray(b"raw")
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nshort\r\n\r\n"))
    with pytest.raises(Exception, match="ends within a record"):
        warc.read_archives(spark, str(tmp_path)).collect()


def test_empty_table(spark):
    path = fresh_path(spark, "warc")
    warc.write_captures(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.assemble(warc.read_archives(spark, path)).count() == 0
