"""WARC archives: a writer, and a reader that splits compressed archives.

The writer makes every page a gzip member of its own and joins members to archives, one file each,
through Spark's own committer, so that a lost task leaves nothing behind. The text sink ends a file
with its line separator, here one zero byte, which gzip readers take for padding.

The reader deals files into byte ranges. A task looks for the gzip magic in its range, and takes a
position for a record only if the member there decompresses to a WARC header that parses, with the
content length and the checksum that belong to it; so neither a magic inside compressed data nor a
range that begins inside a record misleads it. It owns the records that start inside its range and
reads on past the range's end for the last one. A record is held in memory, a file never.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if, materialize

ARCHIVE_BYTES, RANGE_BYTES, READ_BYTES = 32 << 20, 8 << 20, 256 << 10
TASKS = 20_000  # that read archives, at most; each takes its ranges one by one
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_PAGE = re.compile(r"<urn:page:(-?\d+)>")
RECORD = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, revisit: bool, refers_to: int | None, date: str) -> bytes:
    """One gzip member. A revisit keeps the HTTP header alone; its digest and length are the payload's."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}"]
    head.append(f"WARC-Record-ID: <urn:page:{page_id}>" if page_id is not None else f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, url or '')}>")
    head.append(f"WARC-Date: {date}")
    if url is not None:
        head.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head.append(f"WARC-Profile: {PROFILE}")
        if refers_to is not None:
            head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    head += [f"WARC-Payload-Digest: sha1:{digest32(payload)}", f"WARC-Block-Digest: sha1:{digest32(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def duplicates(pages: DataFrame, min_bytes: int = 0, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(id, sha, refers_to) of the pages that revisit another: of equal payloads of at least
    ``min_bytes`` the one with the largest id is the response; a null id is one only among null ids.
    Payloads are equal by SHA-256 and length: those made to share a SHA-1 stay apart."""
    keys = pages.select(F.col(page_id).cast("long").alias("id"), F.coalesce(F.col(html), F.lit("")).alias("h")).select(
        "id", F.sha2("h", 256).alias("sha"), F.octet_length("h").alias("size"))
    first = materialize(
        keys.where(F.col("size") >= min_bytes).groupBy("sha", "size").agg(F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND refers_to IS NOT NULL").select("sha", "size", "refers_to"), "payloads")
    again = keys.join(broadcast_if(first, first.count(), 100), ["sha", "size"]).where(~F.col("id").eqNullSafe(F.col("refers_to")))
    return materialize(again.select("id", "sha", "refers_to").distinct(), "revisits")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Writes a record for every row of ``pages``: null html is an empty payload, a null id or url
    leaves its header out. Repeated rows are written each, and alike: those that repeat the response's id
    and payload are responses too. Pages stay where they are read: what
    repeats is found on digests, and only ids of revisits are joined."""
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    again = duplicates(pages, min_bytes, page_id, html)
    again = broadcast_if(again.select(F.col("id").alias("of"), F.col("sha").alias("of_sha"), F.lit(True).alias("revisit"), "refers_to"), again.count(), 100)
    rows = rows.join(again, F.col("id").eqNullSafe(F.col("of")) & (F.sha2("html", 256) == F.col("of_sha")), "left").select("id", "url", "html", "revisit", "refers_to")

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, size = [], 0
        for batch in batches:
            for i, u, h, again, to in zip(*(batch.column(k) for k in range(5)), strict=True):
                members.append(record(i.as_py(), u.as_py(), h.as_buffer().to_pybytes(), bool(again.as_py()), to.as_py(), date))
                size += len(members[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], ["value"])
                    members, size = [], 0
        if members:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], ["value"])

    # the cast leaves bytes as they are
    out = rows.mapInArrow(archives, "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _member(file, at: int, size: int) -> tuple[bytes, int] | None:
    """The content and end of the record at an offset, or None if no record starts there."""
    expand, out, pos = zlib.decompressobj(31), bytearray(), at
    try:
        while not expand.eof:
            if pos >= size:
                return None
            chunk = file.read_at(min(READ_BYTES, size - pos), pos)
            pos += len(chunk)
            out += expand.decompress(chunk)
            if len(out) >= 7 and not out.startswith(b"WARC/1."):
                return None
    except zlib.error:
        return None
    return (bytes(out), pos - len(expand.unused_data)) if out.startswith(b"WARC/1.") else None


def parse_record(data: bytes) -> dict | None:
    """The fields of RECORD; None if the header does not parse or the lengths disagree."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, colon, v in (x.partition(":") for x in lines[1:]) if colon}
    if not found or not fields.get("content-length", "").isdigit() or len(rest) != int(fields["content-length"]) + 4 or "warc-type" not in fields:
        return None
    http, _, payload = rest[:-4].partition(b"\r\n\r\n")
    revisit = fields["warc-type"] == "revisit"
    sent = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if not revisit:
        digest = digest32(payload)
    own, to = (_PAGE.fullmatch(fields.get(k, "")) for k in ("warc-record-id", "warc-refers-to"))
    return {
        "page_id": int(own[1]) if own else None, "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"],
        "refers_to": int(to[1]) if to else None, "payload": None if revisit else payload,
        "payload_bytes": int(sent[1]) if revisit and sent else len(payload), "payload_digest": digest,
    }


def records_in(file, start: int, end: int, size: int) -> Iterator[dict]:
    """Records that start in [start, end)."""
    pos = start
    while pos < end:
        window = file.read_at(min(READ_BYTES, end - pos + len(MAGIC) - 1, size - pos), pos)
        at = window.find(MAGIC)
        if at < 0:
            pos += max(1, len(window) - len(MAGIC) + 1)
            continue
        if pos + at >= end:
            return
        got = _member(file, pos + at, size)
        parsed = parse_record(got[0]) if got else None
        if parsed is None:
            pos += at + 1
            continue
        yield parsed
        pos = got[1]


def read_archives(spark: SparkSession, path: str, payload: bool = True, range_bytes: int = RANGE_BYTES, tasks: int = TASKS) -> DataFrame:
    """Every record of the archives under ``path``, as RECORD; payloads null without ``payload``.

    Ranges are dealt evenly to ``tasks`` tasks at most. Empty files and folders hold no records.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = ranges.repartition(max(1, min(tasks, ranges.count())))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held = [], 0
                with _open(p) as file:
                    for row in records_in(file, start, min(start + range_bytes, size), size):
                        if not payload:
                            row["payload"] = None
                        rows.append(row)
                        held += len(row["payload"] or b"") + 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return ranges.mapInArrow(read, RECORD)
