"""Operator 4: WARC archives, and a normaliser for monolithic gzip files.

write_archives writes records the way many crawlers wrongly do: one gzip stream for a whole file, in which no record can be reached
without inflating everything before it. normalise inflates each such stream once, from its start to its end, writes every record
as a gzip member of its own, and gives an index of offsets beside it. read_records reads single records by that index.

Archives are rows (archive string, content binary), of about ARCHIVE_BYTES of payload each, so they can be any of Spark's tables in any
store; spark.read.format("binaryFile") gives the same columns for files, and save_files writes such.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import written

#: Payload of an archive; a longer record has an archive of its own.
ARCHIVE_BYTES = 8 << 20
#: Inflated at a time.
STEP = 1 << 18
LEVEL = 1
#: The alphabet of RFC 4648 in its order.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

INDEX = "archive string, record int, offset long, length long, record_type string, target_uri string, payload_digest string"


def base32(sha1: Column) -> Column:
    """Upper-case base32 of a SHA-1's 40 hexadecimal digits: each five digits are four letters of five bits."""
    number = lambda i: F.conv(F.substring(sha1, 1 + 5 * i, 5), 16, 10).cast("int")
    letter = lambda n, shift: F.substring(F.lit(BASE32), (F.shiftright(n, shift).bitwiseAND(F.lit(31)) + 1), F.lit(1))
    return F.concat(*[letter(number(i), shift) for i in range(8) for shift in (15, 10, 5, 0)])


def revisits(pages: DataFrame, id_column: str = "page_id", html_column: str = "html", least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to): of payloads of at least least_bytes that are equal, the one with the smallest id is the response.

    A null payload is an empty one. Rows that repeat the smallest id are responses too. A null id is larger than all others.
    """
    payload = F.coalesce(F.col(html_column), F.lit("")).cast("binary")
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    base = pages.select(F.col(id_column).alias("page_id"), url.alias("url"), payload.alias("payload"))
    base = base.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("sha1"))
    # partial sums meet first, so a payload that a third of all pages share is one row for each task here; a table of its own, of payloads that are repeated, so that the join
    # with it sends no page where it is small, and can be split where it isn't
    firsts = base.filter(F.col("payload_bytes") >= least_bytes).groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").select("sha1", "first_id")
    joined = base.join(written(firsts, "firsts"), "sha1", "left")
    again = (F.col("payload_bytes") >= least_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select(
        "page_id", "url", "payload", "payload_bytes", base32(F.col("sha1")).alias("payload_digest"), F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to"),
    )


def _record(page_id, url, payload: bytes, n: int, digest: str, kind: str, refers) -> bytes:
    urn = lambda x: f"<urn:page:{'' if x is None else x}>"
    target = "".join(c for c in (url or "") if c not in "\r\n")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {n}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: {urn(refers)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def write_archives(records: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Monolithic archives (archive, content) of revisits()' rows: each one gzip stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, packer = [], 0, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([f"{uuid.uuid4().hex}.warc.gz"]), pa.array([b"".join([*parts, packer.flush()])], pa.binary())], names=["archive", "content"])

        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                record = _record(*(x.as_py() for x in row))
                if packer is not None and size + len(record) > archive_bytes:
                    yield done()
                    packer = None
                if packer is None:
                    parts, size, packer = [], 0, zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                parts.append(packer.compress(record))
                size += len(record)
        if packer is not None:
            yield done()

    return records.select("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to").mapInArrow(run, "archive string, content binary")


def _inflated(content: bytes) -> Iterator[bytes]:
    """A gzip file's bytes in order, a step at a time; of one member or many. Zeros between members are padding."""
    view, at, feed, stream = memoryview(content), 0, b"", None
    while feed or at < len(view):
        if not feed:
            feed, at = bytes(view[at : at + STEP]), at + STEP
        if stream is None:
            feed = feed.lstrip(b"\0")
            if not feed:
                continue
            stream = zlib.decompressobj(31)
        out = stream.decompress(feed, STEP)
        if out:
            yield out
        feed, stream = (stream.unused_data, None) if stream.eof else (stream.unconsumed_tail, stream)
    while stream is not None and not stream.eof:  # output that was held back
        out = stream.decompress(b"", STEP)
        if not out and not stream.eof:
            raise ValueError("the gzip stream ends early")
        if out:
            yield out


def _records(content: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """Headers, whole record and the place of its payload, of a WARC file's bytes inflated once."""
    held, chunks = bytearray(), _inflated(content)

    def more() -> bool:
        for chunk in chunks:
            held.extend(chunk)
            return True
        return False

    while held or more():
        if held[:2] == b"\r\n":  # blank lines between records
            del held[:2]
            continue
        at = held.find(b"\r\n\r\n")
        while at < 0:
            seen = max(0, len(held) - 3)
            if not more():
                raise ValueError("a record's head has no end")
            at = held.find(b"\r\n\r\n", seen)
        lines = bytes(held[:at]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record begins with {lines[0][:40]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        end = at + 4 + int(head["content-length"]) + 4
        while len(held) < end and more():
            pass
        if len(held) < end:
            raise ValueError("a record ends early")
        record = bytes(held[:end])
        del held[:end]
        yield head, record, at + 4


def normalise(archives: DataFrame) -> DataFrame:
    """(archive, content, sidecar array of (record, offset, length, record_type, target_uri, payload_digest)): content has each record as a gzip member of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                members, sidecar, offset = [], [], 0
                for i, (head, record, _) in enumerate(_records(content.as_py())):
                    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    member = packer.compress(record) + packer.flush()
                    sidecar.append({"record": i, "offset": offset, "length": len(member), "record_type": head.get("warc-type"), "target_uri": head.get("warc-target-uri"), "payload_digest": head.get("warc-payload-digest")})
                    members.append(member)
                    offset += len(member)
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([b"".join(members)], pa.binary()), pa.array([sidecar], kind)], names=["archive", "content", "sidecar"])

    kind = pa.list_(pa.struct([("record", pa.int32()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string())]))
    inner = "record int, offset long, length long, record_type string, target_uri string, payload_digest string"
    return archives.select("archive", "content").mapInArrow(run, f"archive string, content binary, sidecar array<struct<{inner.replace(' ', ':').replace(',:', ',')}>>")


def offset_index(normalised: DataFrame) -> DataFrame:
    """The sidecar index as rows of INDEX."""
    return normalised.select("archive", F.inline("sidecar"))


def read_records(normalised: DataFrame) -> DataFrame:
    """(record_id, record_type, refers_to, payload_digest, payload_bytes, payload) of each member that the sidecar names: it inflates that member alone, and checks the digest of a response."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        bare = lambda x: x and x.removeprefix("<urn:page:").removesuffix(">") or None
        for batch in batches:
            for content, sidecar in zip(batch.column(0), batch.column(1), strict=True):
                data, entries = memoryview(content.as_buffer()), sidecar.as_py()
                for first in range(0, len(entries), 64):
                    rows = []
                    for e in entries[first : first + 64]:
                        head, record, at = next(_records(bytes(data[e["offset"] : e["offset"] + e["length"]])))
                        payload, kind = record[at:-4], head["warc-type"]
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"the payload of {head['warc-record-id']} isn't the one that was written")
                        rows.append((bare(head["warc-record-id"]), kind, bare(head.get("warc-refers-to")), digest, int(head["x-payload-length"]), payload if kind == "response" else None))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    names = ["record_id", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return normalised.select("content", "sidecar").mapInArrow(run, "record_id string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary")


def save_files(archives: DataFrame, folder: str) -> None:
    """Writes each archive to a file of that name in a folder that all executors see (a mounted one), whole or not at all."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                part = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
                with open(part, "wb") as f:
                    f.write(content.as_buffer())
                os.replace(part, os.path.join(folder, name.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array([], pa.string())], names=["archive"])

    archives.select("archive", "content").mapInArrow(save, "archive string").count()


def round_trip(pages: DataFrame, id_column: str = "page_id", html_column: str = "html", least_bytes: int = 0) -> DataFrame:
    """Archives every row of pages as a WARC record, normalises the archives, and reads them back by their indexes.

    Returns page_id, payload_bytes long, payload_digest string, record_type string, refers_to, and payload binary (null for
    revisits). A null payload is empty; a null id stays null; repeated rows are a record each; an empty table gives no rows.
    """
    kind = pages.schema[id_column].dataType
    archives = written(write_archives(revisits(pages, id_column, html_column, least_bytes)), "archives")
    whole = written(normalise(archives), "normalised")
    return read_records(whole).select(F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "payload")
