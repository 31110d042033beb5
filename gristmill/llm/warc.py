"""WARC archives: writing pages as records, and reading records back with segments put together.

Writing: a page is one HTTP response with a chunked body; blocks over ``segment_bytes`` are cut into a first
record and ``continuation`` records. Records may lie in any file and order. A payload that another page
has already is written as a ``revisit`` without it.

Reading: records are cut out by their Content-Length. Whole ones are decoded where they are; segments are dealt by
origin identifier, sorted by segment number and streamed, so that a task holds one record at a time; the segments' number and total length are verified, the
chunked framing is decoded and the payload's SHA-1 is compared with the one in the header.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

DATE = "2024-01-01T00:00:00Z"
CRLF = b"\r\n"
#: What ends a record.
RECORD_END = CRLF + CRLF
#: An archive holds so many bytes at most, and a segment for each line; a task that reads holds one archive at a time.
ARCHIVE_BYTES, LINE_BYTES = 32 << 20, 1 << 20
#: Revisits that are broadcast, at most; more are joined.
BROADCAST_REVISITS = 1 << 20
_FLUSH = 8 << 20

RECORD = "kind string, record_id string, page_id long, refers_to string, group_id string, segment int, total long, digest string, block binary"
PAYLOAD = "kind string, record_id string, page_id long, refers_to string, digest string, payload binary, problem string"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(body: bytes, size: int) -> bytes:
    """HTTP/1.1 chunked transfer framing of ``body``."""
    parts = []
    for i in range(0, len(body), size):
        part = body[i : i + size]
        parts += [b"%x" % len(part), CRLF, part, CRLF]
    return b"".join([*parts, b"0", CRLF, CRLF])


def dechunked(data: bytes) -> bytes:
    """The body of chunked framing; chunk extensions and trailers are skipped. ValueError if it is cut short."""
    parts, at = [], 0
    while True:
        end = data.find(CRLF, at)
        if end < 0:
            raise ValueError("chunk size line is missing")
        size = int(data[at:end].split(b";")[0].strip(), 16)
        if size == 0:
            return b"".join(parts)
        at = end + 2
        if data[at + size : at + size + 2] != CRLF:
            raise ValueError("chunk is cut short")
        parts.append(data[at : at + size])
        at += size + 2


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """Without the two line ends that close a record: the writer's line separator is those."""
    lines = [b"WARC/1.1"] + [f"{k}: {v}".encode() for k, v in [*fields, ("Content-Length", len(block))] if v is not None]
    return CRLF.join(lines) + CRLF + CRLF + block


def page_records(page_id, url, uid: int, payload: bytes, first, chunk_bytes: int, segment_bytes: int) -> Iterator[bytes]:
    """``first``: None if this page is the response of its payload, else the uid of the page that is."""
    name = lambda n: f"<urn:page-record:{n}>"
    target = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    common = [("WARC-Date", DATE), ("WARC-Target-URI", target), ("X-Page-Id", page_id), ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    http = ("Content-Type", "application/http;msgtype=response")
    if first is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", name(uid)), *common, ("WARC-Profile", profile), ("WARC-Refers-To", name(first)), http], head)
        return
    block = head + chunked(payload, chunk_bytes)
    cuts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    number = ("WARC-Segment-Number", 1 if len(cuts) > 1 else None)
    yield _record([("WARC-Type", "response"), ("WARC-Record-ID", name(uid)), *common, http, number], cuts[0])
    for n, part in enumerate(cuts[1:], 2):
        total = ("WARC-Segment-Total-Length", len(block) if n == len(cuts) else None)
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", name(f"{uid}-{n}")), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name(uid)), ("WARC-Segment-Number", n), total], part)


def write_warc(pages: DataFrame, path: str, chunk_bytes: int = 4096, segment_bytes: int = 32768, min_revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes gzipped WARC files below ``path``.

    Among equal payloads of at least ``min_revisit_bytes`` the row with the smallest id is the response (of
    several such rows, one) and the others revisit it; null ids come last. A null payload is an empty one. A null
    url leaves the target out. A very long payload becomes many segments, in order. Other columns, whatever their names, are
    ignored. An empty table writes no record.

    Pages are numbered and written to the shared folder once; which of them are revisits is decided on ids and digests alone, so
    payloads are never shuffled and the copies of a popular one never meet.
    """
    spark = pages.sparkSession
    rows = pages.select(
        scratch.column(pages, id_col).cast("long").alias("id"),
        scratch.column(pages, url_col).cast("string").alias("url"),
        F.coalesce(scratch.column(pages, html_col).cast("binary"), F.lit(b"")).alias("payload"),
    )
    rows = rows.select("*", F.sha1("payload").alias("sha"), F.octet_length("payload").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("uid"))
    numbered = scratch.save(rows, "pages")
    rows = spark.read.schema(rows.schema).parquet(numbered)
    light = rows.select("id", "sha", "bytes", "uid").where(F.col("bytes") >= min_revisit_bytes)
    firsts = light.groupBy("sha").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "uid")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = scratch.write(firsts.select("sha", F.col("first.uid").alias("first_uid")), "firsts")  # so that the join can split a popular one
    revisits = light.select("sha", "uid").join(firsts, "sha").where("uid <> first_uid").select("uid", "first_uid")
    revisits = scratch.write(revisits, "revisits")
    if revisits.count() <= BROADCAST_REVISITS:
        revisits = F.broadcast(revisits)
    rows = rows.join(revisits, "uid", "left").select("id", "url", "uid", "payload", "first_uid")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines of about LINE_BYTES: some records with two line ends between them."""
        lines, held, size = [], [], 0
        for batch in batches:
            for page_id, url, uid, payload, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for x in page_records(page_id, url, uid, payload, first, chunk_bytes, segment_bytes):
                    held.append(x)
                    size += len(x)
                    if size >= LINE_BYTES:
                        lines.append(RECORD_END.join(held))
                        held, size = [], 0
                    if len(lines) >= 8:
                        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], ["value"])
                        lines = []
        if held:
            lines.append(RECORD_END.join(held))
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], ["value"])

    archives = rows.mapInArrow(records, "value binary").select(F.col("value").cast("string"))
    # As the line separator the end of a record is put behind each line. A line is a segment over LINE_BYTES at most.
    archives.write.options(lineSep=RECORD_END.decode(), compression="gzip", maxRecordsPerFile=max(1, ARCHIVE_BYTES // LINE_BYTES)).text(path)
    scratch.remove(spark, numbered)


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record starts at byte {at}")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        start = end + 4
        if start + size > len(data):
            raise ValueError("the last record is cut short")
        yield fields, data[start : start + size]
        at = start + size + 4


def _is_segment(f: dict[str, str]) -> bool:
    return f.get("warc-type") == "continuation" or "warc-segment-number" in f


def _row(f: dict[str, str], block: bytes) -> tuple:
    number = lambda k: int(f[k]) if k in f else None
    own, digest = f.get("warc-record-id"), f.get("warc-payload-digest")
    return f.get("warc-type"), own, number("x-page-id"), f.get("warc-refers-to"), f.get("warc-segment-origin-id", own), number("warc-segment-number"), number("warc-segment-total-length"), digest and digest.rpartition(":")[2], block


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["kind", "record_id", "page_id", "refers_to", "group_id", "segment", "total", "digest", "block"]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary()]
    for batch in batches:
        for content in batch.column(0):
            out, held = [], 0
            raw = content.as_py()
            for f, block in parse_archive(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw):
                if not _is_segment(f):
                    continue
                out.append(_row(f, block))
                held += len(block)
                if held >= _FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head.replace(b"\r\n", b"\n")) else body


def _joined(parts: list[tuple]) -> tuple:
    """One record from its segments, in the order of their numbers."""
    first = parts[0]
    kind, own, page_id, refers, _, segment, _, digest, block = first
    problem = payload = None
    if kind == "continuation":
        problem = "the first segment is missing"
    elif segment is not None or len(parts) > 1:
        block = b"".join(p[8] for p in parts)
        if [p[5] for p in parts] != list(range(1, len(parts) + 1)):
            problem = "segments are missing or repeated"
        elif parts[-1][6] != len(block):
            problem = "the total length differs"
    if not problem and kind == "response":
        try:
            payload = payload_of(block)
            if digest is not None and sha1_base32(payload) != digest:
                problem = "the payload's digest differs"
        except ValueError as e:
            problem = str(e)
    return kind, own, page_id, refers, digest, payload, problem


_PAYLOAD_TYPES = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]


def _payloads(records: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of some megabytes of put-together records."""
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PAYLOAD_TYPES, strict=True)], ["kind", "record_id", "page_id", "refers_to", "digest", "payload", "problem"])
    out, size = [], 0
    for record in records:
        out.append(record)
        size += len(record[5] or b"") + 200
        if size >= _FLUSH:
            yield table(out)
            out, size = [], 0
    if out:
        yield table(out)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archives to the responses and revisits that are one record."""

    def records():
        for batch in batches:
            for content in batch.column(0):
                raw = content.as_py()
                for f, block in parse_archive(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw):
                    if f.get("warc-type") in ("response", "revisit") and not _is_segment(f):
                        yield _joined([_row(f, block)])

    return _payloads(records())


def _reassembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments, sorted by origin and number, to whole records."""

    def records():
        held: list[tuple] = []
        for batch in batches:
            columns = batch.columns
            for i in range(batch.num_rows):
                row = tuple(c[i].as_py() for c in columns)
                if held and row[4] != held[0][4]:
                    yield _joined(held)
                    held = []
                held.append(row)
        if held:
            yield _joined(held)

    return _payloads(records())


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The responses and revisits of all archives below ``path``: ``kind, record_id, page_id, refers_to, digest, payload, problem``.

    ``problem`` says why a payload could not be put together or verified (missing or repeated segments, wrong
    total length, broken chunks, another digest); it is null for good records. Records of other types are skipped.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    dealt = files.mapInArrow(_segments, RECORD).repartition("group_id").sortWithinPartitions("group_id", F.asc_nulls_first("segment"))
    return files.mapInArrow(_whole, PAYLOAD).unionByName(dealt.mapInArrow(_reassembled, PAYLOAD))


def page_index(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: ``page_id, payload_bytes, payload_digest, record_type, refers_to``, read from the archives.

    A revisit has the size and digest of the response that it refers to; they are null where that is not found
    or could not be put together.
    """
    read = read_warc(spark, path)
    whole = F.col("problem").isNull()
    rows = read.select("kind", "record_id", "page_id", "refers_to", F.when(whole, F.octet_length("payload")).cast("long").alias("payload_bytes"), F.when(whole, F.col("digest")).alias("payload_digest"))
    rows = scratch.write(rows, "warc-index")
    responses = rows.where("kind = 'response'")
    targets = responses.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("target"), "payload_bytes", "payload_digest")
    revisits = rows.where("kind = 'revisit'").select("page_id", "refers_to").join(targets, "refers_to", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return (
        responses.withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long")})
        .select(columns)
        .unionByName(revisits.select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), F.col("target").alias("refers_to")))
    )
