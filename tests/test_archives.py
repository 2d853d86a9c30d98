"""Crawl archives: written and read back, damaged ones, and records at the edges of what is read at once."""

from __future__ import annotations

import gzip
import io

import pytest
from pyspark.sql import functions as F

from crawlgauge.sources import archives


def record(body: bytes, uri="https://a.example/", kind="response", version="1.0") -> bytes:
    content = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-A: 1\r\nX-A: 2\r\n\r\n" + body if kind == "response" else body
    head = f"WARC/{version}\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\nWARC-Record-ID: <urn:{len(body)}>\r\nContent-Length: {len(content)}\r\n\r\n"
    return head.encode() + content + b"\r\n\r\n"


def read(raw: bytes) -> list[tuple]:
    """(type, body, error) of every row."""
    return [(r[2], r[9], r[10]) for r in archives.records(io.BytesIO(raw), "f")]


BODIES = [b"", b"<html>\r\n\r\nWARC/1.0\r\n</html>", b"x" * 70_000, "zażółć".encode(), bytes(range(256)) * 40]


@pytest.mark.parametrize("chunk", [7, 64, 1000, 1 << 20])
def test_records_come_back_however_they_are_read(monkeypatch, chunk):
    monkeypatch.setattr(archives, "CHUNK", max(chunk, 400))
    raw = record(b"software: x\r\n", kind="warcinfo") + b"".join(record(b) for b in BODIES)
    want = [("warcinfo", b"software: x\r\n", None)] + [("response", b, None) for b in BODIES]
    assert read(raw) == want
    assert read(b"".join(gzip.compress(record(b)) for b in BODIES)) == want[1:]
    assert read(gzip.compress(b"".join(record(b) for b in BODIES))) == want[1:]
    assert read(b"") == [] and read(b"\r\n\r\n") == []


def test_damaged_records_are_rows_and_the_next_are_read():
    good = [record(b"one"), record(b"two" * 100), record(b"three")]
    junk = good[0] + b"garbage \x00 without header\r\n\r\n" + good[1]
    assert [r[2] for r in read(junk)] == [None, "no record header", None]
    assert [r[1] for r in read(junk)][1].startswith(b"garbage")
    cut = read(good[0] + good[1][:-60])
    assert cut[0] == ("response", b"one", None) and cut[1][2] == "record is cut off" and b"two".startswith(cut[1][1][:3])
    members = [gzip.compress(g) for g in good]
    broken = members[0] + members[1][:20] + b"\xff" * 9 + members[1][29:] + members[2]
    rows = read(broken)
    assert rows[0] == ("response", b"one", None) and rows[-1] == ("response", b"three", None)
    assert any(r[2] for r in rows[1:-1])
    assert [r[2] for r in read(members[0] + members[1][:-30])][-1] is not None
    assert b"".join(r[1] for r in read(b"z" * 3_000_000)) == b"z" * 3_000_000


def test_folders_of_archives(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = [(f"<urn:{i}>", f"https://a.example/{i}\r\nX: y", "2024-01-01T00:00:00Z", 200 + i % 2 * 204, f"<html>ż{i}</html>".encode() if i else None) for i in range(50)]
    frame = spark.createDataFrame(rows, "record_id string, target_uri string, date string, status int, body binary").withColumn("http_headers", F.create_map(F.lit("Content-Type"), F.lit("text/html")))
    archives.write_archives(frame.repartition(3), folder)
    (tmp_path / "out" / "plain.warc").write_bytes(record(b"plain") + b"junk")
    (tmp_path / "out" / "other.txt").write_bytes(b"not an archive")
    back = archives.read_archives(spark, folder)
    assert back.select("file").distinct().count() == 4 and back.count() == 52
    assert back.where("error IS NOT NULL").select(F.decode("body", "UTF-8")).first()[0] == "junk"
    assert back.where("record_id = '<urn:7>'").select("target_uri", "status").first() == ("https://a.example/7 X: y", 404)
    pages = archives.archived_pages(back)
    assert pages.count() == 26 and pages.where("record_id = '<urn:8>'").first()["html"] == "<html>ż8</html>"
    assert dict(back.where("file = 'plain.warc' AND error IS NULL").first()["http_headers"])["x-a"] == "1, 2"
    empty = tmp_path / "empty"
    empty.mkdir()
    assert archives.read_archives(spark, str(empty)).count() == 0
