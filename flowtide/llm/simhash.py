"""Near copies by 64-bit SimHash, linked through the anchors of a covering code.

Two fingerprints that differ in at most three bits differ in at most one bit of one of their two
halves. The codewords of the perfect Hamming code of length 31 are the anchors of a half (its
first 31 bits): every point lies within one bit of an anchor, which is the covering radius. So a
fingerprint goes to every anchor within covering radius plus threshold = 1 + 1 bits, 16 at most,
and two points one bit apart meet at the anchor nearest to either. Per anchor all 64 bits are
compared. Anchors cut the space into 2 x 2^26 cells, and no cell's links are written out as pairs: a
cell hands on a spanning forest, at most one link per member.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.llm.common import column, grouped_rows, row_key, runs, tasks_for, utf8, without_rows
from flowtide.llm.components import components
from flowtide.session import cut

THRESHOLD = 3
WORDS = 3
SEED = 42
#: members of an anchor that one task compares directly; larger anchors are split by blocks of bits
CELL = 4096
#: rows of (anchor, fingerprint) that one task takes
TASK_ROWS = 1 << 20
#: shingles whose bits are unpacked at a time
SLICE = 1 << 15


def fingerprint(data: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The SimHash of a text's UTF-8 bytes; 0 without words."""
    found = data.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        digests = [xxhash.xxh64_digest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate(([0], ends[: -words] + 1))
        pieces = [joined[a:b] for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)]
        digests = list(map(xxhash.xxh64_digest, pieces, repeat(seed)))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(digests), SLICE):
        part = np.frombuffer(b"".join(digests[i : i + SLICE]), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(digests)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.fromiter((fingerprint(x.as_py()) for x in batch.column("_t")), np.uint64, batch.num_rows)
        names = [n for n in batch.schema.names if n != "_t"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(values.view(np.int64))], [*names, "fp"])


_POINTS = np.arange(1, 32, dtype=np.uint32)
_PAIRS = [np.array([(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if (i ^ s) > i], np.uint32) for s in range(1, 32)]


def syndromes(points: np.ndarray) -> np.ndarray:
    """Of 31-bit points: 0 on a codeword, else the number of the one bit to flip."""
    s = np.zeros(len(points), np.uint32)
    for i in _POINTS:
        s ^= np.where((points >> (i - np.uint32(1))) & np.uint32(1), i, np.uint32(0))
    return s


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and the numbers of the anchors within two bits of either half."""
    rows, found = [], []
    for half in (0, 1):
        points = ((fps >> np.uint64(32 * half + 1)) & np.uint64(0x7FFFFFFF)).astype(np.uint32)
        s = syndromes(points)
        for value in range(32):
            own = np.flatnonzero(s == value)
            flips = np.zeros(1, np.uint32) if value == 0 else np.concatenate((np.array([1 << (value - 1)], np.uint32), _PAIRS[value - 1]))
            rows.append(np.repeat(own, len(flips)))
            found.append(((points[own][:, None] ^ flips[None, :]).astype(np.int64) | (half << 31)).ravel())
    return np.concatenate(rows), np.concatenate(found)


def forest(fps: np.ndarray, most: int = THRESHOLD) -> Iterator[tuple[int, int]]:
    """Links (member, reached from) that join what lies within ``most`` bits of each other."""
    left = fps
    while len(left) > 1:
        edge, left = left[:1], left[1:]
        root = int(edge[0])
        while len(edge) and len(left):
            near = np.zeros(len(left), bool)
            for x in edge:
                near |= np.bitwise_count(left ^ x) <= most
            edge, left = left[near], left[~near]
            for x in edge.tolist():
                yield x, root


def _compare(batches: Iterator[pa.RecordBatch], key: str, cell: int | None) -> Iterator[pa.RecordBatch]:
    """Links of the cells of a partition sorted by ``key``. With ``cell``, the rows of larger cells are
    handed on instead (a = fingerprint, b = null)."""
    for batch in grouped_rows(batches, key):
        fps = column(batch, "fp").astype(np.int64).view(np.uint64)
        bounds = runs(column(batch, key))
        sizes = np.diff(bounds)
        a, b, handed = [], [], []
        two = bounds[:-1][sizes == 2]
        near = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= THRESHOLD]
        a.append(fps[near])
        b.append(fps[near + 1])
        for k in np.flatnonzero(sizes > 2).tolist():
            members = fps[bounds[k] : bounds[k + 1]]
            if cell is not None and len(members) > cell:
                handed.append(members)
            elif links := list(forest(members)):
                x, y = zip(*links, strict=True)
                a.append(np.array(x, np.uint64))
                b.append(np.array(y, np.uint64))
        left, right = np.concatenate(a), np.concatenate(b)
        if len(left):
            yield pa.RecordBatch.from_arrays([pa.array(left.view(np.int64)), pa.array(right.view(np.int64))], ["a", "b"])
        for members in handed:
            yield pa.RecordBatch.from_arrays([pa.array(members.view(np.int64)), pa.nulls(len(members), pa.int64())], ["a", "b"])


def _to_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = column(batch, "fp").astype(np.int64)
        rows, found = anchors(fps.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(fps[rows])], ["anchor", "fp"])


_BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = column(batch, "fp").astype(np.int64)
        for i, chosen in enumerate(combinations(_BLOCKS, 3)):
            value = np.zeros(len(fps), np.uint64)
            for shift, width in chosen:
                value = (value << np.uint64(width)) | ((fps.view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << width) - 1))
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64) | (i << 33)), pa.array(fps)], ["block", "fp"])


def links(distinct: DataFrame, rows: int) -> DataFrame:
    """Links (a, b) between the distinct fingerprints in column ``fp``.

    An anchor with more than ``CELL`` members is split: its fingerprints are dealt by every three of
    six blocks of the 64 bits. Three differing bits leave three blocks alike, so two linked
    fingerprints still meet, in cells that hold 32 more bits fixed.
    """
    spark = distinct.sparkSession
    n = tasks_for(spark, 32 * rows, TASK_ROWS)
    cells = distinct.select("fp").mapInArrow(_to_anchors, "anchor long, fp long").repartition(n, "anchor").sortWithinPartitions("anchor")
    first = cut(cells.mapInArrow(lambda it: _compare(it, "anchor", CELL), "a long, b long"))
    crowded = first.where("b is null").select(F.col("a").alias("fp")).distinct().mapInArrow(_to_blocks, "block long, fp long")
    second = crowded.repartition(n, "block").sortWithinPartitions("block").mapInArrow(lambda it: _compare(it, "block", None), "a long, b long")
    return first.where("b is not null").union(second)


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Documents whose fingerprints differ in at most three bits are linked; component_id is the
    smallest id reachable over links, the document's own included. Texts without words (null, empty,
    white space) have fingerprint zero and are linked like any other. Rows that repeat an id or a
    text belong to one component; null ids do not count for the smallest id (null if there is no
    other). An empty table gives no rows; other columns are ignored.
    """
    marked = cut(docs.select(F.col(doc_id).cast("long").alias("doc_id"), utf8(F.col(text)).alias("_t")).mapInArrow(_fingerprints, "doc_id long, fp long"))
    classes = _smallest(marked, F.col("doc_id")).withColumnRenamed("first", "component_id")
    return marked.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _smallest(marked: DataFrame, of: Column) -> DataFrame:
    """(fp, first): the smallest ``of`` in the component of each fingerprint."""
    first = cut(marked.groupBy("fp").agg(F.min(of).alias("first_id")))

    nodes = components(links(first, first.count())).withColumnRenamed("node", "fp")
    rooted = cut(first.join(nodes, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("first"))
    return rooted.join(smallest, "root").select("fp", "first")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies, with all its columns: the one with the smallest id (null ids
    come last), of texts with this id the one with the smallest SHA-256, and of rows that repeat both
    the smallest by all columns."""
    key = row_key(F.col(doc_id).cast("long"), utf8(F.col(text)))
    source = docs.select(*key, utf8(F.col(text)).alias("_t"))
    marked = cut(source.mapInArrow(_fingerprints, "_id long, _sha string, fp long"))
    # a struct is compared field by field
    own = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_sha").alias("sha"))
    placed = marked.join(_smallest(marked, own), "fp").withColumn("kept", F.col("_id").eqNullSafe(F.col("first.id")) & (F.col("_sha") == F.col("first.sha")))
    again = placed.where("kept").groupBy("_id", "_sha").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return without_rows(docs, key, placed.where("not kept").select("_id", "_sha"), again)
