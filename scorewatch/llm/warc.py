"""WARC archives of Zstandard frames: one frame per record, the dictionary in front.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary; each
record is a frame of its own, compressed with it. Readers load the dictionary, decode frame
by frame and check every record: version line, mandatory headers, declared lengths, the end
of the record and the digests. Any fault raises an error that names the archive.

Pages with equal payloads of at least `least_bytes` are stored once: the row with the largest
page_id as a response, the others as revisits that name it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewatch.llm.common import bounded_batches, pieces_of, share_by_hash, slices, utf8_values, written
from scorewatch.llm.files import make_folder, open_store

DICTIONARY_MAGIC = 0x184D2A5D
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
RECORD_ID = "<urn:page:%s>"
DATE = "2000-01-01T00:00:00Z"
DICTIONARY_ROWS, DICTIONARY_ROW_BYTES, DICTIONARY_BYTES = 1_000, 16_384, 65_536
ARCHIVE_BYTES = 256_000_000
READ_BYTES = 32_768


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line_safe(text: str) -> str:
    """Characters that may not stand in a header line, percent-encoded."""
    return "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def record_of(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response, or a revisit that keeps the response's HTTP headers without its payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", RECORD_ID % page_id), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", _line_safe(url)))
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", RECORD_ID % refers_to)]
    headers += [
        ("WARC-Payload-Digest", "sha1:" + digest_of(payload)), ("WARC-Block-Digest", "sha1:" + digest_of(block)),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block))),
    ]
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in headers)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers with lower-case names, block) of one whole record, checked."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC version line")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ValueError(f"header line {line[:60]!r}")
        headers[name.strip().lower().decode()] = value.strip().decode()
    if missing := [h for h in MANDATORY if h not in headers]:
        raise ValueError(f"headers missing: {missing}")
    if not headers["content-length"].isdigit():
        raise ValueError(f"Content-Length {headers['content-length']!r}")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"block of {len(rest) - 4} bytes, declared {length}")
    block = rest[:length]
    if (told := headers.get("warc-block-digest")) and told != "sha1:" + digest_of(block):
        raise ValueError("block digest differs")
    return headers, block


def page_of(headers: dict[str, str], block: bytes) -> dict:
    """The page that a response or revisit record stands for."""
    http, gap, payload = block.partition(b"\r\n\r\n")
    lengths = [v for k, _, v in (line.partition(b":") for line in http.split(b"\r\n")[1:]) if k.strip().lower() == b"content-length"]
    if not gap or not http.startswith(b"HTTP/") or len(lengths) != 1 or not lengths[0].strip().isdigit():
        raise ValueError("block is no HTTP response")
    size, kind = int(lengths[0]), headers["warc-type"]
    told = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest_of(payload) != told):
        raise ValueError("payload differs from its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in headers):
        raise ValueError("revisit with a payload or without a response")

    def number(record_id: str) -> int | None:
        value = record_id.removeprefix("<urn:page:").removesuffix(">")
        return None if value == "None" else int(value)

    return {
        "page_id": number(headers["warc-record-id"]), "payload_bytes": size, "payload_digest": told, "record_type": kind,
        "refers_to": number(headers["warc-refers-to"]) if kind == "revisit" else None,
        "url": headers.get("warc-target-uri"), "payload": payload if kind == "response" else None,
    }


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from at most DICTIONARY_ROWS payloads of at most DICTIONARY_ROW_BYTES each.

    The rows are those below a bound of a hash, set by their number; only they reach the driver. Too few pages to train on give their own bytes as a raw dictionary; none give none.
    """
    small = pages.where(F.octet_length("html").between(1, DICTIONARY_ROW_BYTES))
    few = share_by_hash(small, small.count(), DICTIONARY_ROWS, "page_id", "html")
    samples = [r["html"].encode() for r in few.select("html").limit(DICTIONARY_ROWS).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES]


def read_records(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of one archive, decoded frame by frame."""
    store, place = open_store(path)
    with store.open_input_stream(place) as source:
        front = source.read(8)
        if len(front) < 8 or struct.unpack("<I", front[:4])[0] != DICTIONARY_MAGIC:
            raise ValueError(f"{path}: no dictionary frame in front")
        size = struct.unpack("<I", front[4:])[0]
        dictionary = source.read(size)
        if len(dictionary) != size:
            raise ValueError(f"{path}: dictionary frame ends early")
        if dictionary[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary itself may be compressed
            dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        decoder = zstandard.ZstdDecompressor(dict_data=known)
        rest, number = b"", 0
        while rest or (rest := source.read(READ_BYTES)):
            frame, parts = decoder.decompressobj(), []
            while not frame.eof:
                if not rest and not (rest := source.read(READ_BYTES)):
                    raise ValueError(f"{path}: record {number} ends early")
                parts.append(frame.decompress(rest))
                rest = frame.unused_data if frame.eof else b""
            try:
                yield parse_record(b"".join(parts))
            except ValueError as fault:
                raise ValueError(f"{path}: record {number}: {fault}") from None
            number += 1


def page_rows(pages: DataFrame) -> DataFrame:
    """page_id, url and html with null payloads as empty ones."""
    bounded_batches(pages.sparkSession)
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write `pages` (page_id, url, html) as archives; returns the manifest (path, records, bytes).

    Rows that tie for the largest page_id of a group are all responses; null ids revisit the
    largest, or are responses where a group has no id. Empty tables give no archive.
    """
    spark = pages.sparkSession
    make_folder(folder)
    rows = page_rows(pages)
    dictionary = train_dictionary(rows)
    keyed = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    groups = (
        keyed.where(F.octet_length("html") >= least_bytes).groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("largest")).where("n > 1 and largest is not null").drop("n")
    )
    # A payload that a third of the pages share is dealt over several tasks by a salt.
    salts = 16
    spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)))
    revisit = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest")) & (F.octet_length("html") >= least_bytes)
    planned = salted.join(spread, ["digest", "salt"], "left").select("page_id", "url", "html", F.col("largest").alias("refers_to"), revisit.alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        encoder = zstandard.ZstdCompressor(level=3, dict_data=known, write_checksum=True)
        out, path, count, size = None, "", 0, 0

        def finish() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([count], pa.int64()), "bytes": pa.array([size], pa.int64())})

        for batch in slices(batches):
            fields = (batch.column(c).to_pylist() for c in ("page_id", "url", "refers_to", "revisit"))
            for page_id, url, refers_to, again, payload in zip(*fields, utf8_values(batch.column("html"))):
                if out is None:
                    path, count, size = f"{folder}/{uuid.uuid4().hex}.warc.zst", 0, 8 + len(dictionary)
                    store, place = open_store(path)
                    out = store.open_output_stream(place)
                    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
                frame = encoder.compress(record_of(page_id, url, payload, refers_to, again))
                out.write(frame)
                count, size = count + 1, size + len(frame)
                if size >= ARCHIVE_BYTES:
                    yield finish()
                    out = None
        if out is not None:
            yield finish()

    # File names are never reused and only files of finished tasks are listed.
    return written(planned.mapInArrow(run, "path string, records long, bytes long"), "archives")


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (and url, payload) of all records."""
    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if with_payload:
        fields, kinds = fields + [("url", pa.string()), ("payload", pa.binary())], kinds + ", url string, payload binary"
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist()):
                held, seen, size = [], 0, 0
                for headers, block in read_records(path):
                    held.append({k: v for k, v in page_of(headers, block).items() if k in schema.names})
                    seen, size = seen + 1, size + len(block)
                    if len(held) >= 4_096 or with_payload and size > 8_000_000:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                if seen != records:
                    raise ValueError(f"{path}: {seen} records, {records} were written")

    return manifest.repartition(pieces_of(manifest.sparkSession), "path").select("path", "records").mapInArrow(run, kinds)
