"""Packing documents into sequences of at most 4096 tokens.

Documents are tokenised where they are read; only lengths travel. Pieces are dealt by hash into shards of
about ``SHARD_SEQUENCES`` sequences, and a shard is packed in one task: pieces above a third of the capacity
are matched greedily, the largest first with the largest partner that fits (two at most share a
sequence, and for such items this is optimal); the smaller ones, largest first, go to the sequence
whose gap fits best, or open a new one. A shard wastes at most part of a sequence more
than one packing of everything would.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.llm import tokens
from flowtide.llm.common import whole
from flowtide.session import cut

CAPACITY = 4096
SHARD_SEQUENCES = 2048


def pieces(docs: DataFrame, doc_id: str, text: str, capacity: int, path: str | None, keep_ids: bool) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document cut at the capacity; with
    ``keep_ids`` also the ids themselves (little-endian unsigned 32-bit)."""
    end = np.array([tokens.END], "<u4").tobytes()
    step = 4 * capacity

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokens.word_ids(path or tokens.vocabulary_path())
        for batch in batches:
            out: list[tuple] = []
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("_t"), strict=True):
                ids = words.text(t.as_py()) + end
                for k in range(0, len(ids), step):
                    part = ids[k : k + step]
                    out.append((i, k // step, k // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(F.col(text)).alias("_t")).mapInArrow(
        encode, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
    )


def place(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece."""
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    sizes = lengths.tolist()
    n_large = int((lengths[order] * 3 > capacity).sum())
    large, small = order[:n_large].tolist(), order[n_large:].tolist()
    # ascending (length, piece); the largest is taken from the end
    waiting = [(sizes[i], i) for i in reversed(large)]
    gaps: list[tuple[int, int]] = []  # (free tokens, sequence), ascending
    n = 0
    while waiting:
        size, i = waiting.pop()
        sequence[i], free = n, capacity - size
        fit = bisect_right(waiting, (free, len(sizes)))
        if fit:
            other, j = waiting.pop(fit - 1)
            sequence[j], offset[j] = n, size
            free -= other
        if free:
            gaps.append((free, n))
        n += 1
    gaps.sort()
    for i in small:
        size = sizes[i]
        fit = bisect_left(gaps, (size, -1))
        if fit < len(gaps):
            free, into = gaps.pop(fit)
        else:
            free, into, n = capacity, n, n + 1
        sequence[i], offset[i] = into, capacity - free
        if free > size:
            insort(gaps, (free - size, into))
    return sequence, offset


def pack(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None, keep_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A null or empty text is the end id alone. Only documents longer than the capacity are cut. Rows
    that repeat an id are packed each by itself. Sequence numbers are unique but not dense. An empty
    table gives no rows; other columns are ignored.
    """
    made = cut(pieces(docs, doc_id, text, capacity, path, keep_ids))
    total = made.agg(F.sum("length").alias("n")).first()["n"] or 0
    shards = max(1, total // (SHARD_SEQUENCES * capacity))
    full = F.col("length") == capacity

    def pack_shard(table: pa.Table) -> pa.Table:
        sequence, offset = place(table.column("length").to_numpy(), capacity)
        shard = table.column("shard")[0].as_py()
        table = table.drop_columns(["shard"])
        return table.append_column("sequence_id", pa.array(sequence + (shard << 32))).append_column("offset", pa.array(offset))

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    # a full piece is a sequence by itself and needs no packing
    alone = made.where(full).select(*names, (F.monotonically_increasing_id() + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    dealt = made.where(~full).select(*names, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).alias("shard"))
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    packed = dealt.groupBy("shard").applyInArrow(pack_shard, f"{kinds}, sequence_id long, offset long")
    return packed.unionByName(alone)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, ids (little-endian unsigned 32-bit) and the documents in order.
    ``packed`` has the ids (``keep_ids``)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    whole_ids = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", whole_ids.alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"))
