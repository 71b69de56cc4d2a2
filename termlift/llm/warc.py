"""WARC archives: records with revisit deduplication, and a salvage reader.

Writing. Each page is a record; of pages with equal payloads the one with the smallest id is a `response`, which
holds an HTTP header and the payload, the others are `revisit` records that name it (payloads below `min_bytes` are
all responses). Archives are WARC/1.1 files written by Spark's text writer, so they land in any store that Spark
writes to, through its committer. Every record is a gzip member; what the writer puts after each line is an empty
gzip member, so the file is a valid sequence of members. Plain archives (compressed=False) have CRLF there, which
is the second one that ends a record. A line is a bundle of records of at most `bundle` bytes and an archive is at most
`per_file` lines, so its size is bounded; a page above `bundle` bytes is an archive of its own.

Reading. An archive's records are parsed one after the other and checked: version line, header, length,
the blank line after the block, and the sha1 digests of the block and the payload (which for application/http
is what follows the HTTP header, as sent or without its chunks). After a failed check the reader searches for the next valid
gzip member or version line, takes up again there, and logs the bytes between as a gap (start, length,
reason). Every byte of an archive belongs to a record, an empty member or a gap. A member that holds several records
counts with its first; the others, and what is broken between them, have its start and length 0. Records are handed on
as they are read, and a member is inflated block by block, so the work is in proportion to the archive and what is
held beside it is one member.

Defined cases: a null html is an empty payload; a null id is written as empty and read back as null, and
such a page is never referred to; rows that repeat the smallest id of a payload are all responses; pages of any length
are written whole; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import forget, new_path, written

MIN_BYTES, DATE, BUNDLE, PER_FILE = 0, "2024-01-01T00:00:00Z", 4 << 20, 32
#: Bytes inflated in one go, bytes of records in a batch, and the longest header that is believed.
_INFLATE, _BATCH, _HEADER = 1 << 16, 8 << 20, 1 << 20
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_GZIP = re.compile(rb"\x1f\x8b\x08")
_LINE = re.compile(rb"([^\r\n]*)\r\n")
_MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encode(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None = None, date: str = DATE) -> bytes:
    """A record without its last CRLF. A revisit has no payload; the payload's length is in a header of its own."""
    kind = "response" if refers_to is None else "revisit"
    name = "" if page_id is None else page_id
    target = "".join(" " if c in "\r\n" else c for c in url or "")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{sha1}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return b"".join(["\r\n".join(lines).encode(), b"\r\n\r\n", block, b"\r\n"])


def member(record: bytes) -> bytes:
    """The record, whole, as a gzip member."""
    return gzip.compress(record + b"\r\n", 6, mtime=0)


_EMPTY = gzip.compress(b"", mtime=0)


# ------------------------------------------------------------------ salvage reader


@dataclass
class Record:
    start: int
    length: int
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        """The block, for application/http without its HTTP header."""
        return self.block.partition(b"\r\n\r\n")[2] if _is_http(self.headers) else self.block


@dataclass
class Gap:
    start: int
    length: int
    reason: str


@dataclass
class Salvage:
    records: list[Record] = field(default_factory=list)
    gaps: list[tuple[int, int, str]] = field(default_factory=list)


class Broken(ValueError):
    pass


def _unchunked(body: bytes) -> bytes | None:
    """The body without its chunks, or None where it has none."""
    out, at = [], 0
    while m := re.compile(rb"([0-9a-fA-F]+)[^\r\n]*\r\n").match(body, at):
        size = int(m[1], 16)
        if not size:
            return b"".join(out)
        out.append(body[m.end() : m.end() + size])
        at = m.end() + size + 2
    return None


def _agrees(claimed: str, data: bytes) -> bool:
    """Whether data has that digest, in base 32 or hexadecimal."""
    return claimed.upper() == digest(data) or claimed.lower() == hashlib.sha1(data).hexdigest()


def _is_http(headers: dict[str, str]) -> bool:
    return headers.get("content-type", "").lower().startswith("application/http")


def _check(headers: dict[str, str], block: bytes) -> None:
    of = lambda name: x[5:] if (x := headers.get(name, ""))[:5].lower() == "sha1:" else None
    if (claimed := of("warc-block-digest")) is not None and not _agrees(claimed, block):
        raise Broken("block digest differs")
    claimed = of("warc-payload-digest")
    if claimed is None or headers.get("warc-type") in ("revisit", "continuation") or "warc-segment-number" in headers:
        return  # the payload is not, or not wholly, in this record
    if not _is_http(headers):
        if not _agrees(claimed, block):
            raise Broken("digest differs")
        return
    body = block.partition(b"\r\n\r\n")[2]
    if not _agrees(claimed, body) and not ((plain := _unchunked(body)) is not None and _agrees(claimed, plain)):
        raise Broken("digest differs")


def _parse(data: bytes | memoryview, at: int) -> tuple[dict[str, str], bytes, int]:
    """Header, block and end of the record at `at`."""
    v = _VERSION.match(data, at)
    if not v:
        raise Broken("no version line")
    headers: dict[str, str] = {}
    start, most = v.end(), v.end() + _HEADER
    while (line := _LINE.match(data, start, min(len(data), most))) and line.end() - start > 2:
        name, colon, value = line[1].partition(b":")
        if not colon:
            raise Broken("bad header line")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
        start = line.end()
    if not line:
        raise Broken("header has no end")
    if missing := [h for h in _MANDATORY if not headers.get(h)]:
        raise Broken(f"no header {missing[0]}")
    size = headers.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", size):
        raise Broken("bad content length")
    start = line.end()
    stop = start + int(size)
    if bytes(data[stop : stop + 4]) != b"\r\n\r\n":
        raise Broken("block does not end where it should")
    block = bytes(data[start:stop])
    _check(headers, block)
    return headers, block, stop + 4


def _inflate(data: memoryview, at: int) -> tuple[bytes, int]:
    """The gzip member at `at`, and where it ends."""
    z, parts = zlib.decompressobj(31), []
    while not z.eof:
        if at >= len(data):
            raise Broken("gzip member has no end")
        block = data[at : at + _INFLATE]
        try:
            parts.append(z.decompress(block))
        except zlib.error as e:
            raise Broken(f"bad gzip member: {e}") from None
        if not any(parts) and len(block) == _INFLATE:
            raise Broken("gzip header has no end")
        at += len(block) - len(z.unused_data)
    return b"".join(parts), at


class _Starts:
    """Where a record or member may start next. Each mark's next place is kept until it is passed."""

    def __init__(self, data: memoryview):
        self.data = data
        self.next = {_VERSION: -1, _GZIP: -1}

    def after(self, at: int) -> int:
        for mark, place in self.next.items():
            if place < at:
                m = mark.search(self.data, at)
                self.next[mark] = m.start() if m else len(self.data)
        return min(self.next.values())


def _members(inner: bytes) -> tuple[list[tuple[dict[str, str], bytes]], list[str]]:
    """The records of a member, and why what lies between them is none. Without any record: Broken."""
    found, faults, at, lost = [], [], 0, False
    while at < len(inner):
        try:
            headers, block, at = _parse(inner, at)
        except Broken as e:
            if not lost:
                faults.append(str(e))
            lost = True
            v = _VERSION.search(inner, at + 1)
            at = v.start() if v else len(inner)
            continue
        found.append((headers, block))
        lost = False
    if not found:
        raise Broken(faults[0])
    return found, faults


def read(data: bytes | memoryview) -> Iterator[Record | Gap]:
    """All records of an archive that pass their checks and the gaps between them, in order."""
    data = memoryview(data)
    starts, at, broken, why = _Starts(data), 0, -1, ""
    while at < len(data):
        faults: list[str] = []
        try:
            if _GZIP.match(data, at):
                inner, end = _inflate(data, at)
                found, faults = _members(inner) if inner else ([], [])
            else:
                headers, block, end = _parse(data, at)
                found = [(headers, block)]
        except Broken as e:
            if broken < 0:
                broken, why = at, str(e)
            at = starts.after(at + 1)
            continue
        if broken >= 0:
            yield Gap(broken, at - broken, why)
            broken = -1
        for k, (headers, block) in enumerate(found):
            yield Record(at, 0 if k else end - at, headers, block)
        for fault in faults:
            yield Gap(at, 0, fault)
        at = end
    if broken >= 0:
        yield Gap(broken, len(data) - broken, why)


def salvage(data: bytes | memoryview) -> Salvage:
    """What read() finds, in two lists."""
    out = Salvage()
    for x in read(data):
        if isinstance(x, Record):
            out.records.append(x)
        else:
            out.gaps.append((x.start, x.length, x.reason))
    return out


# ------------------------------------------------------------------ on Spark


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES, bundle: int = BUNDLE, per_file: int = PER_FILE, compressed: bool = True) -> None:
    """Write a record for every page into archives under path, each of at most per_file bundles of records."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for i, u, p, d, r in zip(*(c.to_pylist() for c in batch.columns)):
                x = encode(i, u, p or b"", base64.b32encode(bytes.fromhex(d)).decode(), r)
                x = member(x) if compressed else x
                if held and size + len(x) > bundle:
                    yield one(held)
                    held, size = [], 0
                held.append(x)
                size += len(x)
        if held:
            yield one(held)

    def one(held: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([(b"" if compressed else b"\r\n").join(held)], pa.binary())], names=["records"])

    def write(rows: DataFrame, most: int, mode: str) -> None:
        lines = rows.mapInArrow(records, "records binary").select(F.col("records").cast("string").alias("value"))
        end = _EMPTY.decode("latin-1") if compressed else "\r\n"
        lines.write.mode(mode).option("encoding", "ISO-8859-1").option("lineSep", end).option("maxRecordsPerFile", most).text(path)

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    size = F.octet_length("payload")
    first = rows.where((size >= min_bytes) & F.col("id").isNotNull()).groupBy("sha1").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.max(size).alias("bytes"))
    # a table of its own, whose size the planner knows: only where it is small is it sent to the pages,
    # else the pages are dealt by digest
    first = written(first.where((F.col("n") > 1) | (F.col("bytes") > bundle)), "first")
    told = rows.join(first.where("n > 1").select("sha1", "first"), "sha1", "left").select("id", "url", "payload", "sha1", F.when(F.col("first") != F.col("id"), F.col("first")).alias("refers_to"))
    told = told.withColumn("refers_to", F.when(F.col("id").isNotNull(), F.col("refers_to")))
    write(told.where(size <= bundle), per_file, "errorifexists")
    if min_bytes > bundle or not first.where(F.col("bytes") > bundle).isEmpty() or not rows.where(F.col("id").isNull() & (size > bundle)).isEmpty():
        write(told.where(size > bundle), 1, "append")
    forget(pages.sparkSession, first)


def read_archives(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, gaps) of all archives under path: what passed its checks, and what was quarantined."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    kinds = {"archive": pa.string(), "start": pa.int64(), "length": pa.int64(), "headers": pa.map_(pa.string(), pa.string()), "block": pa.binary(), "reason": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows: list[tuple] = []
                size = 0
                for x in read(content.as_buffer()):
                    if isinstance(x, Record):
                        rows.append((name, x.start, x.length, list(x.headers.items()), x.block, None))
                        size += len(x.block)
                    else:
                        rows.append((name, x.start, x.length, None, None, x.reason))
                    if size >= _BATCH or len(rows) >= 2000:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], names=list(kinds))

    both = files.mapInArrow(run, "archive string, start long, length long, headers map<string,string>, block binary, reason string")
    return both.where("reason is null").drop("reason"), both.where("reason is not null").select("archive", "start", "length", "reason")


def summary(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of records as of read_archives()."""
    h = lambda name: F.element_at("headers", name)
    page = lambda name: F.expr(f"try_cast(nullif(regexp_extract(element_at(headers, '{name}'), '<urn:page:(.*)>', 1), '') AS BIGINT)")
    return records.select(
        page("warc-record-id").alias("page_id"),
        h("x-payload-length").cast("long").alias("payload_bytes"),
        F.regexp_replace(h("warc-payload-digest"), "^sha1:", "").alias("payload_digest"),
        h("warc-type").alias("record_type"),
        page("warc-refers-to").alias("refers_to"),
    )


def round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write the pages into archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, min_bytes=min_bytes)
    return summary(read_archives(spark, path)[0])
