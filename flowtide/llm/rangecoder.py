"""Token ids in files of range-coded blocks.

The ids of a file are cut into blocks of ``BLOCK`` ids; each starts from a fresh model and has its own
checksum. In a block an id is predicted in two contexts, the last two ids and the last one: each keeps
the id seen there and how often it held. Two estimates of the longer context being right, by the states of
both contexts and by the last id, are mixed with weights that follow whichever does better. The range
coder codes the outcome (longer context right, shorter right, neither); after neither the id itself, in
two bytes, with the block's adaptive order-0 counts.

All blocks of a file are coded side by side: one step takes the next id of every block, in arrays
with an entry per block. Everything is integer arithmetic, so decoding repeats encoding exactly.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowtide.llm import tokens
from flowtide.llm.common import tasks_for, whole
from flowtide.llm.files import read_blobs, write_blobs
from flowtide.session import cut

BLOCK = 4096
#: ids of a file at most, unless one document has more
FILE_IDS = 1 << 23
#: bytes of text that one file takes on average
FILE_BYTES = 16 << 20
HEAD = struct.Struct("<4sIIIIII")
START, END = b"TIDS", b"RCID"

_TWO, _ONE = 11, 10
_CONTEXTS = 32
_LASTS = 64
_TOP = np.uint64(1 << 48)
_LOW = np.uint64(1 << 32)
_MASK = np.uint64((1 << 32) - 1)
_S16, _S48 = np.uint64(16), np.uint64(48)


class Model:
    """The adaptive model of ``n`` blocks."""

    def __init__(self, n: int):
        self.two = np.zeros(n << _TWO, np.uint32)
        self.one = np.zeros(n << _ONE, np.uint32)
        self.by_state = np.full(n * _CONTEXTS, 1 << 15, np.int32)
        self.by_last = np.full(n * _LASTS, 1 << 15, np.int32)
        self.weight = np.full(n * 4, 128, np.int32)
        self.shorter = np.full(n * _CONTEXTS, 1 << 14, np.int32)
        self.counts = np.ones((2, n, 256), np.int32)
        self.sums = np.zeros((2, n, 257), np.uint64)
        lane = np.arange(n, dtype=np.int64)
        self.base_two, self.base_one = lane << _TWO, lane << _ONE
        self.base_state, self.base_last, self.base_weight = lane * _CONTEXTS, lane * _LASTS, lane * 4
        self.refresh(n)

    def refresh(self, n: int) -> None:
        """Cumulative counts out of 2^16, at least 1 for each byte value."""
        total = np.cumsum(self.counts[:, :n], axis=2, dtype=np.int64)
        self.sums[:, :n, 1:] = total * (65536 - 256) // total[:, :, -1:] + np.arange(1, 257)

    def predict(self, n: int, last: np.ndarray, before: np.ndarray) -> None:
        """Look up the contexts of the first ``n`` blocks; ``last`` and ``before`` are uint32."""
        one = last * np.uint32(0x9E3779B1)
        self.at_two = self.base_two[:n] + (((before * np.uint32(0x85EBCA6B)) ^ one) >> np.uint32(32 - _TWO))
        self.at_one = self.base_one[:n] + (one >> np.uint32(32 - _ONE))
        self.e2, self.e1 = self.two[self.at_two], self.one[self.at_one]
        self.c2 = self.e2 & np.uint32(3)
        self.c1 = self.e1 & np.uint32(3)
        self.p2, self.p1 = self.e2 >> np.uint32(2), self.e1 >> np.uint32(2)
        self.same = self.p1 == self.p2
        state = (self.c2 << np.uint32(3)) | (self.c1 << np.uint32(1)) | self.same
        self.at_state = self.base_state[:n] + state
        self.at_last = self.base_last[:n] + (one >> np.uint32(26))
        self.at_weight = self.base_weight[:n] + self.c2
        self.a, self.b, self.w = self.by_state[self.at_state], self.by_last[self.at_last], self.weight[self.at_weight]
        self.s = self.shorter[self.at_state]
        mixed = (self.a * self.w + self.b * (256 - self.w)) >> 8
        self.f0 = np.minimum(np.maximum(mixed, 64), 65000)
        f1 = ((65536 - self.f0) * (self.s >> 2)) >> 14
        self.f1 = np.where(self.same, 0, np.minimum(np.maximum(f1, 16), 65500 - self.f0))

    def update(self, ids: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        """Learn the ids just coded (uint32); hits as booleans."""
        goal = hit2.astype(np.int32) << 16
        da, db = goal - self.a, goal - self.b
        self.by_state[self.at_state] = self.a + (da >> 5)
        self.by_last[self.at_last] = self.b + (db >> 4)
        self.weight[self.at_weight] = self.w + (np.where(np.abs(da) < np.abs(db), 256 - self.w, -self.w) >> 4)
        open_ = ~hit2
        self.shorter[self.at_state] = self.s + np.where(open_, ((hit1.astype(np.int32) << 16) - self.s) >> 5, 0)
        fresh = ids << np.uint32(2)
        self.two[self.at_two] = np.where(hit2, self.e2 + (self.c2 < 3), np.where(self.c2 > 1, self.e2 - np.uint32(1), fresh))
        right = self.p1 == ids
        self.one[self.at_one] = np.where(right, self.e1 + (self.c1 < 3), np.where(self.c1 > 1, self.e1 - np.uint32(1), fresh))


def _refreshed(step: int) -> bool:
    return step in (16, 64, 128) or step % 256 == 0 and step > 0


class Encoder:
    def __init__(self, n: int, units: int):
        self.low, self.range = np.zeros(n, np.uint64), np.full(n, (1 << 64) - 1, np.uint64)
        self.units, self.used = np.zeros((n, units), np.uint16), np.zeros(n, np.int64)

    def code(self, rows, start: np.ndarray, size: np.ndarray) -> None:
        """Code the share [start, start + size) of 2^16 in the blocks ``rows`` (a slice or numbers)."""
        part = self.range[rows] >> _S16
        self.low[rows] += part * start
        self.range[rows] = wide = part * size
        small = np.flatnonzero(wide < _LOW)
        if len(small):
            self._shift(small if isinstance(rows, slice) else rows[small])

    def _shift(self, rows: np.ndarray) -> None:
        while len(rows):
            low, wide = self.low[rows], self.range[rows]
            across = (low ^ (low + wide - np.uint64(1))) >= _TOP
            wide = np.where(across, (np.uint64(0) - low) & _MASK, wide)
            used = self.used[rows]
            if used.max() + 4 >= self.units.shape[1]:
                self.units = np.concatenate((self.units, np.zeros_like(self.units)), axis=1)
            self.units[rows, used] = low >> _S48
            self.used[rows] = used + 1
            self.low[rows] = low << _S16
            self.range[rows] = wide = wide << _S16
            rows = rows[wide < _LOW]

    def close(self) -> list[bytes]:
        if self.used.max(initial=0) + 4 >= self.units.shape[1]:
            self.units = np.concatenate((self.units, np.zeros_like(self.units)), axis=1)
        out = []
        for i in range(len(self.low)):
            n = int(self.used[i])
            self.units[i, n : n + 4] = np.array([int(self.low[i]) >> s & 0xFFFF for s in (48, 32, 16, 0)], np.uint16)
            out.append(self.units[i, : n + 4].astype("<u2").tobytes())
        return out


class Decoder:
    def __init__(self, payloads: list[bytes]):
        n = len(payloads)
        sizes = [len(p) // 2 for p in payloads]
        self.units = np.zeros((n, max(sizes, default=0) + 8), np.uint16)
        for i, p in enumerate(payloads):
            self.units[i, : sizes[i]] = np.frombuffer(p, "<u2")
        self.low, self.range = np.zeros(n, np.uint64), np.full(n, (1 << 64) - 1, np.uint64)
        self.value, self.used = np.zeros(n, np.uint64), np.full(n, 4, np.int64)
        for j in range(4):
            self.value = (self.value << _S16) | self.units[:, j].astype(np.uint64)

    def take(self, rows, start: np.ndarray, size: np.ndarray, part: np.ndarray) -> None:
        """Drop a decoded share; ``part`` is the width of one of the 2^16 shares."""
        self.low[rows] += part * start
        self.range[rows] = wide = part * size
        small = np.flatnonzero(wide < _LOW)
        rows = small if isinstance(rows, slice) else rows[small]
        while len(rows):
            low, wide = self.low[rows], self.range[rows]
            across = (low ^ (low + wide - np.uint64(1))) >= _TOP
            wide = np.where(across, (np.uint64(0) - low) & _MASK, wide)
            used = self.used[rows]
            self.value[rows] = (self.value[rows] << _S16) | self.units[rows, used].astype(np.uint64)
            self.used[rows] = used + 1
            self.low[rows] = low << _S16
            self.range[rows] = wide = wide << _S16
            rows = rows[wide < _LOW]

    def byte(self, rows: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Decode a byte in each of ``rows`` with the cumulative counts ``sums`` of all blocks."""
        part = self.range[rows] >> _S16
        offset = self.value[rows] - self.low[rows]
        found = np.zeros(len(rows), np.int64)
        for bit in (128, 64, 32, 16, 8, 4, 2, 1):
            found += np.where(part * sums[rows, found + bit] <= offset, bit, 0)
        start = sums[rows, found]
        self.take(rows, start, sums[rows, found + 1] - start, part)
        return found


def _lanes(lengths: np.ndarray) -> list[int]:
    """For each step the number of blocks that still have an id (lengths in descending order)."""
    longest = int(lengths[0]) if len(lengths) else 0
    return np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right").tolist()


def encode_blocks(ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """Payloads of blocks: row b of ``ids`` (uint16) has lengths[b] ids, lengths descending."""
    n = len(lengths)
    model, coder = Model(n), Encoder(n, ids.shape[1] + 8)
    last, before = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    columns = np.ascontiguousarray(ids.T)
    for step, k in enumerate(_lanes(lengths)):
        if _refreshed(step):
            model.refresh(k)
        last, before = last[:k], before[:k]
        model.predict(k, last, before)
        now = columns[step, :k].astype(np.uint32)
        hit2 = model.p2 == now
        hit1 = (model.p1 == now) & ~hit2
        f0, f1 = model.f0, model.f1
        start = np.where(hit2, 0, np.where(hit1, f0, f0 + f1))
        size = np.where(hit2, f0, np.where(hit1, f1, 65536 - f0 - f1))
        coder.code(slice(0, k), start.astype(np.uint64), size.astype(np.uint64))
        rows = np.flatnonzero(~(hit2 | hit1))
        if len(rows):
            for side, values in enumerate((now[rows] >> np.uint32(8), now[rows] & np.uint32(255))):
                low = model.sums[side, rows, values]
                coder.code(rows, low, model.sums[side, rows, values + 1] - low)
                model.counts[side, rows, values] += 24
        model.update(now, hit2, hit1)
        last, before = now, last
    return coder.close()


def decode_blocks(payloads: list[bytes], lengths: np.ndarray) -> np.ndarray:
    """The ids of blocks, as ``encode_blocks`` had them."""
    n = len(lengths)
    model, coder = Model(n), Decoder(payloads)
    last, before = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    columns = np.zeros((int(lengths[0]) if n else 0, n), np.uint16)
    for step, k in enumerate(_lanes(lengths)):
        if _refreshed(step):
            model.refresh(k)
        last, before = last[:k], before[:k]
        model.predict(k, last, before)
        f0, f1 = model.f0, model.f1
        part = coder.range[:k] >> _S16
        offset = coder.value[:k] - coder.low[:k]
        hit2 = offset < part * f0.astype(np.uint64)
        known = offset < part * (f0 + f1).astype(np.uint64)
        hit1 = known & ~hit2
        start = np.where(hit2, 0, np.where(hit1, f0, f0 + f1))
        size = np.where(hit2, f0, np.where(hit1, f1, 65536 - f0 - f1))
        coder.take(slice(0, k), start.astype(np.uint64), size.astype(np.uint64), part)
        now = np.where(hit2, model.p2, model.p1)
        rows = np.flatnonzero(~known)
        if len(rows):
            high = coder.byte(rows, model.sums[0])
            low = coder.byte(rows, model.sums[1])
            model.counts[0, rows, high] += 24
            model.counts[1, rows, low] += 24
            now[rows] = (high << 8) | low
        model.update(now, hit2, hit1)
        columns[step, :k] = now
        last, before = now, last
    return columns.T


def encode_file(ids: np.ndarray, docs: list[tuple[int | None, int]], part: int, number: int) -> bytes:
    """A file without its closing mark: head, payloads, table of blocks, table of documents.

    ``ids`` (uint16) are the ids of all documents in turn, ``docs`` the (doc_id, ids) of each;
    (part, number) orders the files.
    """
    n = -(-len(ids) // BLOCK)
    lengths = np.full(n, BLOCK, np.int64)
    if n:
        lengths[-1] = len(ids) - BLOCK * (n - 1)
    rows = np.zeros((n, BLOCK), np.uint16)
    rows.reshape(-1)[: len(ids)] = ids
    payloads = encode_blocks(rows, lengths) if n else []
    blocks = np.zeros((n, 3), "<u4")
    blocks[:, 0] = lengths
    blocks[:, 1] = [len(p) for p in payloads]
    blocks[:, 2] = [zlib.crc32(ids[i * BLOCK : (i + 1) * BLOCK].astype("<u2").tobytes()) for i in range(n)]
    names = np.array([i if i is not None else 0 for i, _ in docs], "<i8").tobytes()
    absent = np.array([i is None for i, _ in docs], np.uint8).tobytes()
    counts = np.array([c for _, c in docs], "<u8").tobytes()
    table = zlib.compress(names + absent + counts)
    head = HEAD.pack(START, 1, part, number, n, len(docs), len(table))
    return b"".join([head, *payloads, blocks.tobytes(), table])


def decode_file(data: bytes) -> tuple[int, int, np.ndarray, list[tuple[int | None, int]]]:
    """(part, number, ids, docs) of a file with its closing mark; every block's checksum is tested."""
    mark, version, part, number, n, n_docs, size = HEAD.unpack_from(data)
    if mark != START or version != 1 or data[-4:] != END:
        raise ValueError("not a file of token ids")
    at = len(data) - 4 - size
    table = zlib.decompress(data[at : at + size])
    blocks = np.frombuffer(data, "<u4", 3 * n, at - 12 * n).reshape(n, 3)
    ends = np.cumsum(blocks[:, 1].astype(np.int64)) + HEAD.size
    payloads = [data[e - b : e] for e, b in zip(ends.tolist(), blocks[:, 1].tolist(), strict=True)]
    lengths = blocks[:, 0].astype(np.int64)
    rows = decode_blocks(payloads, lengths)
    found = []
    for i, (length, _, crc) in enumerate(blocks.tolist()):
        own = np.ascontiguousarray(rows[i, :length])
        if zlib.crc32(own.astype("<u2").tobytes()) != crc:
            raise ValueError(f"block {i} of file {part}/{number} does not match its checksum")
        found.append(own)
    names = np.frombuffer(table, "<i8", n_docs).tolist()
    absent = np.frombuffer(table, np.uint8, n_docs, 8 * n_docs).tolist()
    counts = np.frombuffer(table, "<u8", n_docs, 9 * n_docs).tolist()
    docs = [(None if a else i, c) for i, a, c in zip(names, absent, counts, strict=True)]
    return part, number, np.concatenate(found) if found else np.zeros(0, np.uint16), docs


def write_ids(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> None:
    """Write the ids of all documents in ascending order of their ids, each with the end id, to files
    below ``path``. Null texts are the end id alone; null ids come first. Rows that repeat an id stand next to
    each other, in any order. An empty table writes no file; other columns are ignored."""
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(F.col(text)).alias("_t"))
    size = source.agg(F.sum(F.octet_length("_t")).alias("n")).first()["n"] or 0
    ordered = source.repartitionByRange(tasks_for(spark, size, FILE_BYTES), "doc_id").sortWithinPartitions("doc_id")
    end = np.array([tokens.END], np.uint16)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        words = tokens.word_ids(vocabulary or tokens.vocabulary_path())
        held: list[np.ndarray] = []
        names: list[tuple[int | None, int]] = []
        n = 0

        def file() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([encode_file(np.concatenate(held), names, part, number)], pa.binary())], ["blob"])

        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("_t"), strict=True):
                ids = np.frombuffer(words.text(t.as_py()), "<u4")
                if len(ids) and ids.max() > 0xFFFF:
                    raise ValueError("the file format holds ids below 2^16")
                if names and n + len(ids) > FILE_IDS:
                    yield file()
                    held, names, n, number = [], [], 0, number + 1
                held += [ids.astype(np.uint16), end]
                names.append((i, len(ids) + 1))
                n += len(ids) + 1
        if names:
            yield file()

    write_blobs(ordered.mapInArrow(encode, "blob binary"), path, END)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            part, number, ids, docs = decode_file(content.as_py())
            ends = np.cumsum([c for _, c in docs])
            data = ids.astype("<u2").tobytes()
            step = 4096
            for k in range(0, len(docs), step):
                own = docs[k : k + step]
                lows = [int(e) - c for e, (_, c) in zip(ends[k : k + step], own, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * len(own), pa.int32()), pa.array([number] * len(own), pa.int32()), pa.array([i for i, _ in own], pa.int64()),
                        pa.array(lows, pa.int64()), pa.array([c for _, c in own], pa.int64()),
                        pa.array([data[2 * a : 2 * (a + c)] for a, (_, c) in zip(lows, own, strict=True)], pa.binary()),
                    ],
                    ["part", "number", "doc_id", "offset", "n_tokens", "ids"],
                )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files below ``path``: part and number (the file), doc_id, offset (ids
    before it in the file), n_tokens, ids (little-endian unsigned 16-bit)."""
    return read_blobs(spark, path).mapInArrow(_decoded, "part int, number int, doc_id long, offset long, n_tokens long, ids binary")


def checksums(read: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 (of the ids as 32-bit numbers)
    of what ``read_ids`` gives."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crcs = [zlib.crc32(np.frombuffer(x.as_py(), "<u2").astype("<u4").tobytes()) for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("part", "number", "doc_id", "offset", "n_tokens")), pa.array(crcs, pa.int64())], ["part", "number", "doc_id", "offset", "n_tokens", "ids_crc32"])

    rows = cut(read.mapInArrow(crc, "part int, number int, doc_id long, offset long, n_tokens long, ids_crc32 long"))
    # one row per file: a file holds millions of ids
    files = rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1))
    starts = files.select("part", "number", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(starts, ["part", "number"]).select("doc_id", (F.col("_before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
