"""WARC archives: writer, and a reader that salvages damaged files.

Files are gzip, one member a record, as WARC/1.1 asks.  The reader checks
each member (gzip checksum, version line, header, content length, block and
payload digest).  After a failed check it searches for the next gzip header
that starts a member whose content opens with a version line, or, in plain
files, for the next version line, and goes on there; the bytes in between are
logged as a quarantined gap.

Defined results: a null payload counts as empty; an empty table writes no
file; rows without page_id are written, never serve as the response that
others refer to while the group has an id, and a group without any id stays
all response; rows that repeat a page_id are all written.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, partitions, written
from .storage import AtomicFile, reader

VERSION = b"WARC/1.1"
#: A file is closed above this many bytes.
FILE_BYTES = 64 << 20
READ_BYTES = 1 << 20
GZIP_MAGIC = b"\x1f\x8b\x08"
VERSION_LINE = re.compile(rb"WARC/\d\.\d+\r?\n")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(name: str) -> str:
    """The same for each attempt at writing a record."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def record(fields: dict[str, str], block: bytes) -> bytes:
    head = [VERSION.decode(), *(f"{k}: {v}" for k, v in fields.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def page_record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """A response with its payload, or a revisit of another page's response."""
    uri = re.sub(r"[\r\n]+", " ", url or "")
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(f"page:{page_id}:{uri}"),
        "WARC-Date": date,
        "WARC-Target-URI": uri,
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Page-Id": "" if page_id is None else str(page_id),
        "X-Payload-Bytes": str(len(payload)),
    }
    block = HTTP_HEAD + payload
    if refers_to is not None:
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields["X-Refers-To-Page-Id"] = str(refers_to)
        block = HTTP_HEAD
    fields["WARC-Block-Digest"] = f"sha1:{sha1_base32(block)}"
    return record(fields, block)


# -- writing --------------------------------------------------------------


def with_digest(pages: DataFrame) -> DataFrame:
    """pages with payload (binary) and digest (base32 SHA-1)."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload")).withColumn("sha", F.sha1("payload"))


def first_pages(pages: DataFrame, least_bytes: int) -> DataFrame:
    """sha, first_id of payloads that several pages have."""
    known = with_digest(pages).select("page_id", "sha", F.length("payload").alias("n")).filter(F.col("n") >= least_bytes)
    groups = known.groupBy("sha").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_id"))
    return groups.filter("pages > 1 and first_id is not null").select("sha", "first_id")


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes a record a page; a row (part, uri, records) for each file.

    Pages with a payload of least_bytes or more that an earlier page_id has
    already are written as revisits.
    """
    firsts = written(first_pages(pages, least_bytes), "first_pages")
    rows = with_digest(pages)
    # Only payloads that repeat need the lookup; the rest stay where they are.
    looked_up = written(
        rows.select("page_id", "sha", F.length("payload").alias("n"))
        .filter(F.col("n") >= least_bytes)
        .join(firsts, "sha")
        .filter("page_id is null or page_id <> first_id")
        .select("page_id", "sha", "first_id")
        .distinct(),
        "revisits",
    )
    tied = rows.join(looked_up, rows.page_id.eqNullSafe(looked_up.page_id) & (rows.sha == looked_up.sha), "left").select(
        rows.page_id, "url", "payload", F.col("first_id").alias("refers_to")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, out, count, number = TaskContext.get().partitionId(), None, 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist([{"part": part, "uri": uri, "records": count}])

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    uri = f"{folder}/part-{part:06d}-{number:04d}.warc.gz"
                    out, count, number = AtomicFile(uri), 0, number + 1
                    out.write(member(record({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(uri), "WARC-Date": date, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")))
                payload = row["payload"]
                out.write(member(page_record(row["page_id"], row["url"], payload, sha1_base32(payload), row["refers_to"], date)))
                count += 1
                if out.size > FILE_BYTES:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return tied.mapInArrow(run, "part long, uri string, records long")


# -- reading --------------------------------------------------------------


class Damaged(ValueError):
    pass


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """Header fields (lower-case names), block, and bytes of the record that data starts with."""
    line = VERSION_LINE.match(data)
    end = data.find(b"\r\n\r\n")
    if not line or end < 0:
        raise Damaged("no version line or no end of the header")
    fields: dict[str, str] = {}
    for text in data[line.end() : end].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = text.partition(":")
        if not colon:
            raise Damaged("a header line without colon")
        fields[name.strip().lower()] = value.strip()
    if not fields.get("content-length", "").isdigit():
        raise Damaged("no content length")
    start = end + 4
    size = int(fields["content-length"])
    block = data[start : start + size]
    if len(block) < size or data[start + size : start + size + 4] != b"\r\n\r\n":
        raise Damaged("the block is cut off")
    digest = fields.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != sha1_base32(block):
        raise Damaged("the block does not have its digest")
    return fields, block, start + size + 4


class Source:
    """A file read forward in pieces.  What is needed is kept in one buffer;
    bytes that were dropped are cut off when they are more than the rest."""

    def __init__(self, stream):
        self.stream, self.base = stream, 0
        self.data, self.at = bytearray(), 0

    def __len__(self) -> int:
        return len(self.data) - self.at

    def more(self) -> bool:
        piece = self.stream.read(READ_BYTES)
        self.data += piece
        return bool(piece)

    def need(self, count: int) -> bool:
        """Whether count bytes are there, reading them first."""
        while len(self) < count and self.more():
            pass
        return len(self) >= count

    def view(self, start: int = 0, stop: int | None = None) -> bytes:
        return bytes(memoryview(self.data)[self.at + start : len(self.data) if stop is None else self.at + stop])

    def find(self, pattern: re.Pattern, start: int) -> int:
        """The place of the next match at or after start; -1 if there is none."""
        m = pattern.search(self.data, self.at + start)
        return m.start() - self.at if m else -1

    def drop(self, count: int) -> None:
        self.at += count
        self.base += count
        if self.at > max(READ_BYTES, len(self.data) - self.at):
            del self.data[: self.at]
            self.at = 0


#: A binary value cannot be longer, so a longer record stays a gap.
MOST_BYTES = (1 << 31) - (1 << 16)


def _gzip_record(source: Source) -> tuple[dict[str, str], bytes, int]:
    """The record of the member that the source starts with.  The first bytes
    must open with a version line, so that no wrong member is read to its end."""
    z, plain, at, size = zlib.decompressobj(31), [], 0, 0
    while not z.eof:
        if at >= len(source) and not source.more():
            raise Damaged("the member is cut off")
        stop = min(len(source), at + READ_BYTES)
        try:
            piece = z.decompress(source.view(at, stop))
        except zlib.error as e:
            raise Damaged(str(e)) from None
        if not size and piece and not b"WARC/".startswith(piece[:5]):
            raise Damaged("the member does not hold a record")
        plain.append(piece)
        at, size = stop, size + len(piece)
        if size > MOST_BYTES:
            raise Damaged("the member is too long")
    used = at - len(z.unused_data)
    fields, block, size = parse_record(content := b"".join(plain))
    if size != len(content):
        raise Damaged("the member holds more than a record")
    return fields, block, used


HEAD_END, HEAD_BYTES = re.compile(rb"\r\n\r\n"), 4096
LENGTH = re.compile(rb"(?im)^content-length:\s*(\d+)")


def _plain_record(source: Source) -> tuple[dict[str, str], bytes, int]:
    """The record that the source starts with: its head first, then as much as that states."""
    end, looked = -1, 0
    while end < 0 and (not looked or VERSION_LINE.match(source.data, source.at)):
        source.need(looked + HEAD_BYTES)
        end = source.find(HEAD_END, max(0, looked - 3))
        if len(source) < looked + HEAD_BYTES:
            break
        looked += HEAD_BYTES
    if end < 0 or not VERSION_LINE.match(source.data, source.at):
        raise Damaged("no version line or no end of the header")
    end += source.at
    stated = LENGTH.search(source.data, source.at, end + 2)
    wanted = end - source.at + 4 + (int(stated[1]) if stated else 0) + 4
    if wanted > MOST_BYTES:
        raise Damaged("the record is too long")
    source.need(wanted)
    return parse_record(source.view(0, wanted))


def _starts_record(source: Source, at: int) -> bool:
    """Whether a gzip member at a place opens with a version line, however long its header is."""
    z, plain = zlib.decompressobj(31), b""
    while len(plain) < 16 and not z.eof:
        source.need(at + LOOK_BYTES)
        if at >= len(source):
            break
        try:
            plain += z.decompress(source.view(at, min(len(source), at + LOOK_BYTES)), 64)
        except zlib.error:
            return False
        at += LOOK_BYTES
    return bool(VERSION_LINE.match(plain))


START = re.compile(rb"WARC/\d\.\d+\r?\n|" + re.escape(GZIP_MAGIC))
#: Of a gzip member that may start a record, so much is looked at at a time.
LOOK_BYTES = 4096


def _skip(source: Source) -> None:
    """Drops bytes up to the next place that looks like a record, or all."""
    start = 1
    while True:
        at = source.find(START, start)
        if at < 0:
            # A start may be cut by the end of what was read.
            source.drop(max(0, len(source) - 16) if len(source) > start + 16 else 0)
            start = min(start, len(source))
            if not source.more():
                source.drop(len(source))
                return
            continue
        if source.data[source.at + at] == GZIP_MAGIC[0]:
            if not _starts_record(source, at):
                source.drop(at)
                start = 1
                continue
        source.drop(at)
        return


def records(stream) -> Iterator[tuple[str, int, int, dict[str, str], bytes]]:
    """("record", offset, bytes, fields, block), and ("gap", offset, bytes,
    {"reason": ...}, b"") for what was quarantined."""
    source, gap, reason = Source(stream), None, ""
    while source.need(1):
        source.need(16)
        gz = source.data.startswith(GZIP_MAGIC, source.at)
        try:
            fields, block, used = (_gzip_record if gz else _plain_record)(source)
        except Damaged as e:
            if gap is None:
                gap, reason = source.base, str(e)
            _skip(source)
            continue
        if gap is not None:
            yield "gap", gap, source.base - gap, {"reason": reason}, b""
            gap = None
        yield "record", source.base, used, fields, block
        source.drop(used)
    if gap is not None:
        yield "gap", gap, source.base - gap, {"reason": reason}, b""


READ_SCHEMA = (
    "uri string, offset long, bytes long, kind string, record_type string, target_uri string, page_id long, "
    "payload binary, payload_bytes long, payload_digest string, refers_to long, reason string"
)


def _long(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d+", text) else None


def read_warc(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row for each record and each quarantined gap of the files (column uri)."""

    def rows_of(uri: str) -> Iterator[dict]:
        with reader(uri) as stream:
            for kind, offset, size, fields, block in records(stream):
                out = {"uri": uri, "offset": offset, "bytes": size, "kind": kind, "reason": fields.get("reason")}
                if kind == "record":
                    payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
                    revisit = fields.get("warc-type") == "revisit"
                    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    if not revisit and stated and stated != sha1_base32(payload):
                        yield out | {"kind": "gap", "reason": "the payload does not have its digest"}
                        continue
                    out |= {
                        "record_type": fields.get("warc-type"),
                        "target_uri": fields.get("warc-target-uri"),
                        "page_id": _long(fields.get("x-page-id")),
                        "payload": None if revisit or not with_payload else payload,
                        "payload_bytes": _long(fields.get("x-payload-bytes")) if revisit else len(payload),
                        "payload_digest": stated or sha1_base32(payload),
                        "refers_to": _long(fields.get("x-refers-to-page-id")),
                    }
                yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:

        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                rows, held = [], 0
                for row in rows_of(uri):
                    rows.append(row)
                    held += len(row.get("payload") or b"")
                    if len(rows) >= 2000 or held > 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, ARROW_SCHEMA)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, ARROW_SCHEMA)

    return files.select("uri").mapInArrow(run, READ_SCHEMA)


ARROW_SCHEMA = pa.schema(
    [(name, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[kind]) for name, kind in (x.split() for x in READ_SCHEMA.split(", "))]
)


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes pages to archives in the shared folder; a row for each page
    record that the salvage reader finds there."""
    spark = pages.sparkSession
    manifest = written(write_warc(pages, fresh_path(spark, "warc"), least_bytes), "manifest")
    files = manifest.select("uri").repartition(partitions(spark), "uri")
    found = read_warc(files, with_payload=False)
    return found.filter("kind = 'record' and record_type in ('response', 'revisit')").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "uri", "offset"
    )


def quarantined(found: DataFrame) -> DataFrame:
    """The log of byte gaps: uri, offset, bytes, reason."""
    return found.filter(is_gap()).select("uri", "offset", "bytes", "reason")


def is_gap() -> Column:
    return F.col("kind") == "gap"
