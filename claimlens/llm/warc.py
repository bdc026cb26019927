"""WARC records in seekable Zstandard bundles, written and read back by Spark tasks.

Pages with equal payloads (SHA-1, length and a second hash agree) of at least ``least`` bytes share one response, that of the
largest page_id; the others are written as revisit records that name it. Each task writes its records in a row:
``FRAME_BYTES`` of records make one independent Zstandard frame, and a bundle ends after ``BUNDLE_BYTES`` with a seek table in a
skippable frame (compressed and plain size of each frame, number of frames, magic), so one frame can be read
without the others. The index, a table, maps every record id to bundle, frame, and offset and length inside the frame.

Bundles go to the shared folder under names that no other attempt uses. Only bundles that a finished task reports
are in the index, so a lost executor or a repeated task leaves unused files at worst, never a broken or double record.
Reading takes index rows sorted by bundle and frame, looks the frame up in the bundle's seek table and unpacks it once.

Defined results: a null html is an empty payload, a null url an empty target. Rows that repeat a page_id are records of
their own; among equal payloads all rows with the largest page_id are responses. A null page_id stays null; if all ids of a payload
are null, all are responses. Other columns are not read. An empty table writes nothing and reads nothing.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha1
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, scratch, small_batches, stored

LEAST = 1000
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 64 << 20
LEVEL = 3
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # magic numbers of the published seekable format
INDEX = "path string, frame int, at long, size long, record_id string"


def prepared(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null for responses)."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    keys = rows.where(F.col("size") >= least).select("digest", "size", F.xxhash64("payload").alias("hash"), "page_id")
    shared = keys.groupBy("digest", "size", "hash").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    shared = shared.select(F.col("digest").alias("s_digest"), F.col("size").alias("s_size"), F.col("hash").alias("s_hash"), "first_id")
    same = (F.col("digest") == F.col("s_digest")) & (F.col("size") == F.col("s_size")) & (F.xxhash64("payload") == F.col("s_hash"))
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id")), F.col("first_id"))
    return rows.join(shared, same, "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def record(record_id: str, page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC/1.1 record; a revisit holds headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{record_id}>",
        f"WARC-Date: {date}", f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}", f"X-Page-ID: {'' if page_id is None else page_id}",
        *([] if refers_to is None else ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]),
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", "",
    ]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    return fields, rest[:int(fields["Content-Length"])]


class Bundle:
    """A bundle being written: frames one after the other, the seek table last."""

    def __init__(self, folder: str, level: int):
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        self.path = f"{path}/{uuid.uuid4().hex}.warc.zst"
        self.file = fs.open_output_stream(self.path, compression=None)
        self.pack = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.frame: list[bytes] = []
        self.plain = self.written = 0

    def add(self, raw: bytes) -> tuple[int, int]:
        """(frame, offset) of the record."""
        if self.plain >= FRAME_BYTES:
            self.flush()
        at = (len(self.frames), self.plain)
        self.frame.append(raw)
        self.plain += len(raw)
        return at

    def flush(self) -> None:
        if self.frame:
            packed = self.pack.compress(b"".join(self.frame))
            self.file.write(packed)
            self.frames.append((len(packed), self.plain))
            self.written += len(packed)
            self.frame, self.plain = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        self.file.write(struct.pack("<II", SKIPPABLE, len(table) + 9) + table + struct.pack("<IBI", len(self.frames), 0, SEEKABLE))
        self.file.close()


@lru_cache(64)
def seek_table(folder: str, path: str) -> list[tuple[int, int]]:
    """(start, packed size) of each frame, from the footer alone."""
    fs, _ = filesystem(folder)
    with fs.open_input_file(path) as f:
        size = f.size()
        f.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEKABLE or flags & 0x7C:
            raise ValueError(f"{path}: no seek table")
        f.seek(size - 9 - 8 * n)
        sizes = [struct.unpack("<II", f.read(8))[0] for _ in range(n)]
    starts = [0]
    for s in sizes:
        starts.append(starts[-1] + s)
    return list(zip(starts, sizes, strict=False))


def write(rows: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", level: int = LEVEL) -> DataFrame:
    """Writes ``prepared`` rows to bundles under ``folder``; returns the stored index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, index = None, []
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle and bundle.written >= BUNDLE_BYTES:
                    bundle.close()
                    yield from done(index)
                    bundle, index = None, []
                bundle = bundle or Bundle(folder, level)
                name = str(uuid.uuid4())
                raw = record(name, page_id, url, payload, digest, refers_to, date)
                index.append((bundle.path, *bundle.add(raw), len(raw), name))
        if bundle:
            bundle.close()
            yield from done(index)

    def done(index: list[tuple]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*index, strict=True), kinds, strict=True)],
                                         names=["path", "frame", "at", "size", "record_id"])

    return stored(rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, INDEX), "warc-index")


def read(index: DataFrame, folder: str, id_type: str = "bigint") -> DataFrame:
    """The records that ``index`` rows point to: record_id, page_id, url, payload (null for revisits), payload_bytes,
    payload_digest, record_type, refers_to."""
    schema = ("record_id string, page_id string, url string, payload binary, payload_bytes long, payload_digest string,"
              " record_type string, refers_to string")
    names = [f.split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        unpack = zstandard.ZstdDecompressor()
        held, plain = None, b""
        for batch in batches:
            out = []
            for path, frame, at, size, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (path, frame) != held:
                    start, packed = seek_table(folder, path)[frame]
                    with fs.open_input_file(path) as f:
                        f.seek(start)
                        plain = unpack.decompress(f.read(packed))
                    held = (path, frame)
                head, block = parse(plain[at:at + size])
                if head["WARC-Record-ID"] != f"<urn:uuid:{name}>":
                    raise ValueError(f"{path}: frame {frame} has another record at {at}")
                kind = head["WARC-Type"]
                payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:") if payload is None else sha1(payload).hexdigest()
                length = int(head["X-Payload-Length"]) if payload is None else len(payload)
                out.append((name, head["X-Page-ID"] or None, head["WARC-Target-URI"], payload, length, digest, kind, head.get("X-Refers-To-Page-ID")))
            kinds = (pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    order = index.repartition("path", "frame").sortWithinPartitions("path", "frame", "at").select("path", "frame", "at", "size", "record_id")
    out = order.mapInArrow(run, schema)
    return out.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


def archived(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Writes the pages to a new folder of bundles and returns what ``read`` finds there."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = scratch(spark, "warc")
    return read(write(prepared(pages, least), folder), folder, pages.schema["page_id"].dataType.simpleString())
