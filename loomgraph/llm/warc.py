"""WARC archives: pages written as gzip members with revisits for equal payloads, and a reader that salvages damaged files.

Writing goes through Spark's text writer, so archives land wherever Spark writes. A record is one gzip member whose
last byte is 0 (it is the top byte of its length; members of 16 MB or more are followed by an empty member, which ends
in 0); that byte is the line separator.
"""

from __future__ import annotations

import base64
import hashlib
import contextlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.shared import attach

_MAGIC = b"\x1f\x8b\x08"
_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_VERSION = re.compile(rb"(?:^|(?<=\n))WARC/1\.[01]\r\n")
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_GZIP = 31


def base32_digest(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits are four base32 digits."""
    hexed = F.sha1(payload)
    digits = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str) -> bytes:
    """A response, or a revisit of ``first`` with the response's HTTP head only."""
    revisit = page_id != first
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{_sha1(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """``data`` as a gzip member that ends in a 0 byte."""
    squeeze = zlib.compressobj(4, zlib.DEFLATED, _GZIP)
    out = squeeze.compress(data) + squeeze.flush()
    return out if out[-1] == 0 else out + member(b"")


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, records_a_file: int = 5000, date: str = "2024-01-01T00:00:00Z") -> None:
    """One record per row of ``pages`` (page_id, url, html). Null html: an empty payload; null url: no target.

    Of equal payloads of ``least_bytes`` or more the one with the smallest page_id is the response. Rows that repeat a
    page_id with one payload are of one type. Columns of other names are not looked at.
    """
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload")).withColumn("digest", base32_digest(F.col("payload")))
    firsts = pages.select(F.col("page_id").cast("long").alias("page_id"), base32_digest(F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))).alias("digest")).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    known = attach(given, firsts, "digest", "n", "page_id").withColumn("first", F.when(F.octet_length("payload") >= least_bytes, F.col("first")).otherwise(F.col("page_id")))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "first")), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array((member(record(*(x.as_py() for x in r), date))[:-1] for r in rows), pa.binary())], ["member"])

    members = known.select("page_id", "url", "payload", "digest", "first").mapInArrow(packed, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", records_a_file).text(path)


def _parsed(data: bytes, at: int) -> tuple[dict, int]:
    """The record at ``at`` and where it ends; ValueError names the failed check."""
    if not _LINE.match(data, at):
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("head without end")
    head = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("bad head line")
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = head.get("content-length", "")
    if not length.isdigit():
        raise ValueError("no content length")
    start, stop = end + 4, end + 4 + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("wrong length")
    block = data[start:stop]
    if head.get("warc-block-digest", "").startswith("sha1:") and head["warc-block-digest"][5:] != _sha1(block):
        raise ValueError("block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    said = re.search(rb"\r\nContent-Length: (\d+)", http)
    kind, digest = head.get("warc-type", ""), head.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and digest and digest != _sha1(payload):
        raise ValueError("payload digest")

    def page(name: str) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", head.get(name, ""))
        return int(found[1]) if found else None

    size = len(payload) if kind == "response" else int(said[1]) if said else 0
    return {"page_id": page("warc-record-id"), "url": head.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": page("warc-refers-to"), "payload": payload if kind == "response" else None}, stop + 4


def _member(data: bytes, at: int) -> tuple[int, bytes, str]:
    """(end, content, reason) of the gzip member at a place; with a reason if it isn't whole, and then what was inflated before it broke."""
    inflate, parts, step = zlib.decompressobj(_GZIP), [], at
    try:
        while not inflate.eof and step < len(data):  # by steps: the rest of the file isn't copied for each member
            parts.append(inflate.decompress(data[step : step + 65_536]))
            step += 65_536
    except zlib.error as e:
        inflate = zlib.decompressobj(_GZIP)
        parts = [inflate.decompress(data[k : k + 65_536]) for k in range(at, step, 65_536)]
        with contextlib.suppress(zlib.error):
            for k in range(step, min(step + 65_536, len(data))):  # byte by byte up to the error
                parts.append(inflate.decompress(data[k : k + 1]))
        return at, b"".join(parts), f"bad member: {e}"
    if not inflate.eof:
        return at, b"".join(parts), "cut member"
    return min(step, len(data)) - len(inflate.unused_data), b"".join(parts), ""


def _records(data: bytes) -> Iterator[tuple[int, int, dict | str]]:
    """(from, to, record) or (from, to, reason): after a failed check the search goes on at the next version line."""
    at, lost, why = 0, None, ""
    while at < len(data):
        try:
            found, end = _parsed(data, at)
        except ValueError as e:
            lost, why = (at, str(e)) if lost is None else (lost, why)
            line = _VERSION.search(data, at + 1)
            at = line.start() if line else len(data)
            continue
        if lost is not None:
            yield lost, at, why
            lost = None
        yield at, end, found
        at = end
    if lost is not None:
        yield lost, len(data), why


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | str]]:
    """Records and gaps of one archive, its records in gzip members or plain or both, with their byte ranges in the file.

    After a failed check the search goes on at the next member or version line. A gap inside a member has the member's range;
    whole records of a broken member have the range up to there.
    """
    at, lost, why = 0, None, ""
    magic = version = -1
    while at < len(data):
        end, rows, saved = at, [], []
        if data.startswith(_MAGIC, at):
            end, content, problem = _member(data, at)
            found = [x for _, _, x in _records(content)]
            rows, saved = ([], [x for x in found if isinstance(x, dict)]) if problem else (found, [])
        else:
            try:
                row, end = _parsed(data, at)
                rows, problem = [row], ""
            except ValueError as e:
                problem = str(e)
        if problem:
            lost, why = (at, problem) if lost is None else (lost, why)
            if magic <= at:
                found_at = data.find(_MAGIC, at + 1)
                magic = len(data) if found_at < 0 else found_at
            if version <= at:
                line = _LINE.search(data, at + 1)
                version = line.start() if line else len(data)
            start, at = at, min(magic, version)
            yield from ((start, at, x) for x in saved)
            continue
        if lost is not None:
            yield lost, at, why
            lost = None
        yield from ((at, end, x) for x in rows)
        at = end
    if lost is not None:
        yield lost, len(data), why


_FIELDS = "file string, from_byte long, to_byte long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, quarantined string"


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record, and one per quarantined gap (``quarantined`` says why; the record's columns are null).

    A file is read whole by one task: archives are written with a bound on their records.
    """
    schema = pa.schema([("file", pa.string()), ("from_byte", pa.int64()), ("to_byte", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("quarantined", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows = []
                for start, stop, found in salvage(content.as_py()):
                    row = {"file": file.as_py(), "from_byte": start, "to_byte": stop} | (found if isinstance(found, dict) else {"quarantined": found})
                    rows.append(row if payloads else row | {"payload": None})
                    if len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, _FIELDS)
