"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that can be decompressed by themselves. A bundle is one file: its frames,
a skippable frame with the record map (record identifier, frame, offset and length in that frame),
and a skippable frame with the seek table, which ends the file with its magic number as the seekable
format has it. Any Zstandard tool reads a bundle as one stream; a reader that wants one record looks it up
in the map, finds the frame in the seek table and decompresses that frame alone.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.llm.common import SENT_IDS, utf8
from flowtide.llm.files import read_blobs, write_blobs
from flowtide.session import cut

#: payloads below this size are stored whole even if they repeat
LEAST_REVISIT = 100
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
DATE = "1970-01-01T00:00:00Z"

# fixed values of the Zstandard and seekable formats
SKIPPABLE_MAP = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
MAGIC = struct.pack("<I", SEEK_MAGIC)

_ENTRY = struct.Struct("<16sIII")
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page: int | None, digest: str) -> uuid.UUID:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page}:{digest}")


def record(page: int | None, url: str | None, payload: bytes, digest: str, size: int, first: int | None) -> bytes:
    """One WARC record; ``first`` names the page whose response a revisit refers to."""
    head = [f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{record_id(page, digest)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if first is None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    else:
        block = b"HTTP/1.1 200 OK\r\n\r\n"
        head += [f"WARC-Profile: {_REVISIT_PROFILE}", f"WARC-Refers-To: <urn:uuid:{record_id(first, digest)}>", f"X-Refers-To-Page-ID: {first}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.1", *head, "", ""]).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record."""
    head, block = data.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = block[: int(fields["Content-Length"])]
    return fields, block.split(b"\r\n\r\n", 1)[1]


class Bundle:
    """Collects records; ``close`` gives the bundle's bytes without the closing magic number."""

    def __init__(self) -> None:
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.places: list[bytes] = []
        self.open: list[bytes] = []
        self.held = self.size = 0
        self.compressor = zstandard.ZstdCompressor(level=3, write_checksum=True)

    def add(self, name: uuid.UUID, data: bytes) -> None:
        self.places.append(_ENTRY.pack(name.bytes, len(self.frames), self.held, len(data)))
        self.open.append(data)
        self.held += len(data)
        if self.held >= FRAME_BYTES:
            self._end_frame()

    def _end_frame(self) -> None:
        if self.open:
            frame = self.compressor.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.held))
            self.size += len(frame)
            self.open, self.held = [], 0

    def close(self) -> bytes:
        self._end_frame()
        places = b"".join(self.places)
        places = struct.pack("<II", SKIPPABLE_MAP, len(places)) + places
        table = b"".join(struct.pack("<II", *s) for s in [*self.sizes, (len(places), 0)])
        seek = struct.pack("<II", SKIPPABLE_SEEK, len(table) + 9) + table + struct.pack("<IB", len(self.sizes) + 1, 0)
        return b"".join([*self.frames, places, seek])


class Reader:
    """Random access to the records of one bundle file (with its closing magic number)."""

    def __init__(self, data: bytes):
        n, flags, magic = struct.unpack_from("<IBI", data, len(data) - 9)
        if magic != SEEK_MAGIC or flags:
            raise ValueError("no seek table at the end of the bundle")
        at = len(data) - 9 - 8 * n
        if struct.unpack_from("<II", data, at - 8) != (SKIPPABLE_SEEK, 8 * n + 9):
            raise ValueError("the seek table has another size")
        self.data, self.starts, start = data, [], 0
        for i in range(n):
            size, _ = struct.unpack_from("<II", data, at + 8 * i)
            self.starts.append((start, start + size))
            start += size
        low, high = self.starts.pop()
        if start != at - 8 or struct.unpack_from("<I", data, low)[0] != SKIPPABLE_MAP:
            raise ValueError("frames and seek table do not fit")
        self.places = [_ENTRY.unpack_from(data, i) for i in range(low + 8, high, _ENTRY.size)]
        self.number = {p[0]: i for i, p in enumerate(self.places)}
        self.frame: tuple[int, bytes] = (-1, b"")

    def at(self, i: int) -> bytes:
        _, frame, offset, size = self.places[i]
        if self.frame[0] != frame:
            a, b = self.starts[frame]
            self.frame = (frame, zstandard.ZstdDecompressor().decompress(self.data[a:b]))
        return self.frame[1][offset : offset + size]

    def find(self, name: uuid.UUID) -> bytes:
        return self.at(self.number[name.bytes])

    def records(self) -> Iterator[bytes]:
        return (self.at(i) for i in range(len(self.places)))


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def closed(bundle: Bundle) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([bundle.close()], pa.binary())], ["blob"])

    bundle = Bundle()
    for batch in batches:
        columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "n", "first")]
        for row in range(batch.num_rows):
            page, url, payload, digest, size, first = (c[row].as_py() for c in columns)
            bundle.add(record_id(page, digest), record(page, url, payload or b"", digest, size, first))
            if bundle.size >= BUNDLE_BYTES:
                yield closed(bundle)
                bundle = Bundle()
    if bundle.places:
        yield closed(bundle)


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write a record per row of ``pages`` into bundles below ``path``.

    The payload is the html in UTF-8, null as empty. Of equal payloads of at least ``LEAST_REVISIT``
    bytes the one with the smallest id is a response, the others are revisits of it that store no payload.
    Rows that repeat that id are responses too; a row without an id is a revisit if any row with an
    id has its payload, else a response. Other columns are ignored; an empty table writes no bundle.
    """
    base = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), utf8(F.col(html)).alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload").cast("long"))
    groups = base.select("page_id", "digest", "n").where(F.col("n") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("_c"))
    groups = cut(groups.where("_c > 1").select("digest", "first"))
    if groups.count() <= SENT_IDS:
        groups = F.broadcast(groups)
    known = base.join(groups, "digest", "left")
    first = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = known.select("page_id", "url", F.when(first.isNull(), F.col("payload")).alias("payload"), "digest", "n", first.alias("first"))
    write_blobs(rows.mapInArrow(_bundles, "blob binary"), path, MAGIC)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def number(text: str | None) -> int | None:
        return None if text is None else int(text)

    for batch in batches:
        for content in batch.column("content"):
            out: list[tuple] = []
            held = 0
            for data in Reader(content.as_py()).records():
                fields, payload = parse_record(data)
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                response = fields["WARC-Type"] == "response"
                if response and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(fields["X-Payload-Length"])):
                    raise ValueError(f"the payload of {fields['WARC-Record-ID']} does not match its digest")
                out.append((number(fields.get("X-Page-ID")), fields.get("WARC-Target-URI"), payload if response else None, int(fields["X-Payload-Length"]), digest, fields["WARC-Type"], number(fields.get("X-Refers-To-Page-ID"))))
                held += len(payload)
                if held > BUNDLE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the bundles below ``path``: page_id, url, payload (null for revisits),
    payload_bytes, payload_digest, record_type, refers_to."""
    return read_blobs(spark, path).mapInArrow(
        _records, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )
