"""Operator 2: WARC archives in Zstandard, with the dictionary in the leading skippable frame.

An archive is: a skippable frame (magic 0x184D2A5D) whose content is the dictionary, then one
Zstandard frame for each record. Writing: equal payloads are found by hash, the one with the
smallest page id becomes a response and the others revisits that refer to it. Reading: the
dictionary is loaded from the first frame, every further frame is decoded by itself, and its
header lines, lengths and digests are validated; a damaged archive raises ArchiveError.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, batch_of, dropped_at_end, file_system, fresh_dir, looked_up, read_table, written

MAGIC, FRAME_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
DICTIONARY_BYTES, SAMPLE_ROWS, SAMPLE_BYTES = 32 << 10, 400, 16 << 10
_PAGE = "urn:cloudgauge:page:"
_READ = 1 << 16


class ArchiveError(ValueError):
    """An archive that breaks the format."""


@dataclass
class Record:
    kind: str
    page_id: int | None
    url: str | None
    refers_to: int | None
    payload: bytes
    payload_bytes: int | None
    payload_digest: str | None


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def skippable(content: bytes) -> bytes:
    return struct.pack("<II", MAGIC, len(content)) + content


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for records like the samples; empty if there is too little to learn from."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _line(text: str) -> str:
    """A header value on one line."""
    return " ".join(text.split())


def record_bytes(kind: str, page_id: int | None, url: str | None, refers_to: int | None, payload: bytes, digest: str) -> bytes:
    """A record: named fields, an HTTP head with the payload's length, and for a response the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    own = f"{_PAGE}{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{own}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url:
        fields.append(("WARC-Target-URI", _line(url)))
    if kind == "revisit":
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        fields.append(("WARC-Refers-To", f"<{_PAGE}{refers_to}>"))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def info_bytes() -> bytes:
    """The record that opens an archive."""
    block = b"format: WARC File Format 1.1\r\n"
    fields = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return fields.encode() + block + b"\r\n\r\n"


def _fields(lines: list[bytes], code: str = "utf-8") -> dict[str, str]:
    """Named fields: UTF-8 in WARC, any bytes (as Latin-1) in HTTP."""
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ArchiveError(f"not a header line: {line[:80]!r}")
        try:
            out[name.strip().lower().decode(code)] = value.strip().decode(code)
        except UnicodeDecodeError as e:
            raise ArchiveError(f"a header line is not UTF-8: {line[:80]!r}") from e
    return out


def _page(value: str | None) -> int | None:
    """The page that a record id names; None for ids of other archives."""
    number = (value or "").strip("<>")
    number = number.removeprefix(_PAGE) if number.startswith(_PAGE) else ""
    return int(number) if number.removeprefix("-").isdecimal() else None


def parse(data: bytes) -> Record | None:
    """One decoded frame, validated; None for a record that is no page (warcinfo and others)."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not gap or not first.startswith(b"WARC/1."):
        raise ArchiveError("a frame does not hold a WARC record")
    fields = _fields(lines)
    if not {"warc-type", "warc-record-id", "warc-date", "content-length"} <= fields.keys():
        raise ArchiveError("a mandatory field is missing")
    if not fields["content-length"].isdigit() or len(rest) != (length := int(fields["content-length"])) + 4 or rest[length:] != b"\r\n\r\n":
        raise ArchiveError("Content-Length and the record's length differ")
    block, kind = rest[:length], fields["warc-type"]
    if fields.get("warc-block-digest", "").startswith("sha1:") and fields["warc-block-digest"] != "sha1:" + base32_sha1(block):
        raise ArchiveError("the block does not have the digest that is stated")
    if kind not in ("response", "revisit"):
        return None
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise ArchiveError("a block does not begin with an HTTP head")
    size = _fields(http.split(b"\r\n")[1:], "latin-1").get("content-length")
    if size is not None and not size.isdecimal():
        raise ArchiveError("the payload's stated length is no number")
    if (kind == "revisit" and payload) or (kind == "response" and size is not None and len(payload) != int(size)):
        raise ArchiveError("the payload does not have the length that is stated")
    stated, own = fields.get("warc-payload-digest"), base32_sha1(payload)
    if kind == "response" and stated is not None and stated.startswith("sha1:") and stated != "sha1:" + own:
        raise ArchiveError("the payload does not have the digest that is stated")
    # both are optional: a response's are those of its payload, a revisit's are then unknown
    digest = own if kind == "response" else (stated or "").removeprefix("sha1:") or None
    length = len(payload) if kind == "response" else None if size is None else int(size)
    if kind == "revisit" and ("warc-refers-to" not in fields or "warc-profile" not in fields):
        raise ArchiveError("a revisit does not say what it refers to")
    return Record(kind, _page(fields["warc-record-id"]), fields.get("warc-target-uri"), _page(fields.get("warc-refers-to")), payload, length, digest)


def read_archive(stream: BinaryIO) -> Iterator[Record]:
    """The page records of an archive, one frame each; memory holds one record and one read."""
    pending = stream.read(_READ)
    dictionary = None
    if len(pending) >= 8 and struct.unpack("<I", pending[:4])[0] == MAGIC:
        size = struct.unpack("<I", pending[4:8])[0]
        while len(pending) < 8 + size:
            if not (more := stream.read(_READ)):
                raise ArchiveError("the dictionary frame is cut off")
            pending += more
        content, pending = pending[8 : 8 + size], pending[8 + size :]
        if content.startswith(FRAME_MAGIC):  # the dictionary may itself be compressed
            content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
        dictionary = zstandard.ZstdCompressionDict(content) if content else None
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary)
    while pending or (pending := stream.read(_READ)):
        while len(pending) < 4 and (more := stream.read(_READ)):
            pending += more
        if not pending.startswith(FRAME_MAGIC):
            raise ArchiveError("a record is not in a Zstandard frame of its own")
        frame, parts = decoder.decompressobj(), []
        try:
            parts.append(frame.decompress(pending))
            while not frame.eof:
                if not (more := stream.read(_READ)):
                    raise ArchiveError("the last frame is cut off")
                parts.append(frame.decompress(more))
        except zstandard.ZstdError as e:
            raise ArchiveError(str(e)) from e
        pending = frame.unused_data
        if record := parse(b"".join(parts)):
            yield record


def _dictionary(pages: DataFrame, key: str, html: str) -> bytes:
    """Trained on a sample of at most SAMPLE_ROWS pages, of each at most SAMPLE_BYTES; it only steers compression."""
    rows = pages.agg(F.count(F.lit(1))).first()[0]
    rate = min(1.0, SAMPLE_ROWS / max(rows, 1))
    some = pages.where(F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(1 << 20)) < int(rate * (1 << 20)))
    some = some.select(F.substring(F.col(html).cast("binary"), 1, SAMPLE_BYTES).alias("h")).where("h is not null").limit(SAMPLE_ROWS)
    return train([record_bytes("response", 0, "http://example.org/", None, bytes(r["h"]), base32_sha1(bytes(r["h"]))) for r in some.collect()])


_DONE = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0, level: int = 3, most: int = BROADCAST_ROWS) -> DataFrame:
    """Writes all pages below `path`; (archive, records, bytes), one row an archive.

    Equal payloads of at least `least` bytes share one response, that with the smallest id; null
    ids come last and have record ids of their own. Rows repeated under that smallest id are all
    responses. Null and empty payloads are empty ones; payloads are written whole, however long. Further
    columns, whatever their names, are not read; an empty table gives no archive. Payloads stay where they are while at most
    `most` payloads repeat, else they are shuffled once, evenly. A task that is run
    again writes an archive of another name, and only the names that Spark committed are listed.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = rows.where(F.length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # of digests, only those that repeat; pages of one digest do not meet in one task
    rows = looked_up(rows, written(first, "warc-first"), "digest", F.col("d.digest") == F.col("p.digest"), F.struct("page_id", "url"), "left", most).select("d.page_id", "d.url", "d.payload", "p.first")
    dictionary = spark.sparkContext.broadcast(_dictionary(pages, key, html))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(path)
        name = f"{base}/part-{uuid.uuid4().hex}.warc.zst"
        content = dictionary.value
        encoder = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(content) if content else None)
        out, records, size = None, 0, 0
        try:
            for batch in batches:
                for page_id, link, payload, first in zip(*(c.to_pylist() if k != 2 else c for k, c in enumerate(batch.columns)), strict=True):
                    if out is None:
                        system.create_dir(base, recursive=True)
                        out = system.open_output_stream(name)
                        size += out.write(skippable(content))
                        size += out.write(encoder.compress(info_bytes()))
                    payload = payload.as_py()
                    kind = "response" if first is None or page_id == first else "revisit"
                    size += out.write(encoder.compress(record_bytes(kind, page_id, link, first if kind == "revisit" else None, payload, base32_sha1(payload))))
                    records += 1
        finally:
            if out is not None:
                out.close()
        if records:
            yield batch_of(_DONE, [path.rstrip("/") + name[len(base) :]], [records], [size])

    return rows.select("page_id", "url", "payload", "first").mapInArrow(run, "archive string, records long, bytes long")


_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_archives(archives: DataFrame, column: str = "archive", payloads: bool = True) -> DataFrame:
    """All page records of the archives listed: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    A revisit's payload is null, its bytes and digest are those of the payload it refers to.
    Without `payloads` that column is null throughout. An empty list gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            out = batch_of(_RECORD, *([r[k] for r in rows] for k in range(7)))
            rows.clear()
            return out

        rows, held = [], 0
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                system, name = file_system(archive)
                with system.open_input_stream(name) as stream:
                    for r in read_archive(stream):
                        payload = r.payload if payloads and r.kind == "response" else None
                        rows.append((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.kind, r.refers_to, payload))
                        held += len(payload or b"") + 200
                        if held > 4 << 20:
                            held = 0
                            yield flush()
        if rows:
            yield flush()

    return archives.select(F.col(column)).mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def op2_zstd_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "warc")
    done = written(write_archives(read_table(spark, sf_dir, "pages"), folder), "warc-list")
    dropped_at_end(spark, folder)
    return read_archives(done.repartition(max(1, done.count()), "archive"), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
f AS (SELECT payload, min(page_id) AS first_id FROM p GROUP BY payload)
SELECT p.page_id, CAST(octet_length(p.payload) AS BIGINT) AS payload_bytes, s.payload_digest,
       CASE WHEN p.page_id = f.first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id = f.first_id THEN NULL ELSE f.first_id END AS refers_to
FROM p JOIN f ON p.payload = f.payload
JOIN (
  SELECT payload, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
           (CAST('0x' || substr(sha1(payload) || '000', 1 + CAST(floor(k * 5 / 4) AS INTEGER), 3) AS INTEGER)
             // CAST(power(2, 12 - (k * 5) % 4 - 5) AS INTEGER)) % 32 AS INTEGER), 1), '' ORDER BY k) AS payload_digest
  FROM (SELECT DISTINCT payload FROM p), range(32) AS t(k) GROUP BY payload
) s ON s.payload = p.payload
"""
