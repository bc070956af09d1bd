import base64
import gzip
import hashlib

import pytest

from scorelake.llm import warc


def expected(rows):
    first = {}
    for i, _, html in rows:
        body = (html or "").encode()
        first[body] = min(first.get(body, 1 << 60), 1 << 60 if i is None else i)
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        again = i != first[body] and first[body] != 1 << 60
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first[body] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = [(1, "u", "<p>é</p>"), (2, None, None), (3, "http://x\r\ny", ""), (4, "u", "<p>é</p>"), (5, "u", "WARC/1.0\r\n\r\n" * 9), (6, "u", "long " * 300_000), (None, "u", "nobody"), (1, "u", "<p>é</p>"), (None, "u", "<p>é</p>")] + [(100 + i, "u", "copy") for i in range(500)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")
    got = warc.round_trip(pages).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_small_payloads_are_never_revisits(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(pages, least_bytes=5).collect()) == [(1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3)]


def test_members_and_index(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(40)], "page_id long, url string, html string").coalesce(2)
    archives = warc.written(warc.write_archives(warc.revisits(pages), archive_bytes=4000))
    assert archives.count() > 2
    for row in archives.collect():
        assert gzip.decompress(row.content).count(b"WARC/1.1\r\n") >= 1
    whole = warc.written(warc.normalise(archives))
    content = {r.archive: bytes(r.content) for r in whole.collect()}
    index = warc.offset_index(whole).collect()
    assert len(index) == 40
    for r in index:
        record = gzip.decompress(content[r.archive][r.offset : r.offset + r.length])
        assert record.startswith(b"WARC/1.1\r\n") and record.count(b"WARC-Type") == 1
    warc.save_files(whole, str(tmp_path))
    read = spark.read.format("binaryFile").load(str(tmp_path)).selectExpr("path archive", "content")
    assert warc.offset_index(warc.normalise(read)).count() == 40


def test_inflated(monkeypatch):
    parts = [b"a" * 100_000, b"", b"some bytes", bytes(range(256)) * 300]
    monkeypatch.setattr(warc, "STEP", 61)
    whole = gzip.compress(parts[0]) + b"\0" * 200 + b"".join(map(gzip.compress, parts[1:])) + b"\0\0"
    assert b"".join(warc._inflated(whole)) == b"".join(parts)
    assert b"".join(warc._inflated(b"")) == b""
    with pytest.raises(ValueError):
        list(warc._inflated(gzip.compress(parts[3])[:-20]))
