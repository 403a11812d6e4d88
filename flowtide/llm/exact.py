"""Exact copies by counting quotient filters and a check of the whole bytes' digest.

Each partition of documents builds one counting quotient filter of its 64-bit fingerprints: the
high bits (quotient) choose a slot, the sorted remainders of a slot are kept with their counts.
A filter is cut into blocks of neighbouring quotients; blocks with the same number are merged
by sorting their remainders and adding counts, which loses nothing. Only fingerprints with a
count above one go on: their rows are compared by length and SHA-256 of all bytes, so that two
texts that merely share a fingerprint stay apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.llm.common import SENT_IDS, column, row_key, runs, tasks_for, whole, without_rows
from flowtide.session import cut

#: fingerprints that one merged block holds on average, at most
BLOCK_ROWS = 1 << 20


def normalised(text: Column) -> Column:
    """One space for each run of ASCII white space; null counts as empty."""
    return F.regexp_replace(whole(text), "[\\x20\\x09-\\x0D]+", " ")


class QuotientFilter:
    """Fingerprints as sorted (quotient, remainder) pairs with a count each.

    ``slots`` are the occupied quotients, ``ends`` where the run of each slot ends,
    ``remainders`` the sorted low bits of all runs, ``counts`` how often each occurred.
    """

    def __init__(self, fingerprints: np.ndarray, counts: np.ndarray, quotient_bits: int):
        order = np.argsort(fingerprints, kind="stable")
        fingerprints, counts = fingerprints[order], counts[order]
        starts = runs(fingerprints)[:-1]
        distinct = fingerprints[starts]
        self.bits = quotient_bits
        self.counts = np.add.reduceat(counts, starts) if len(starts) else counts
        shift = np.uint64(64 - quotient_bits)
        quotients = distinct >> shift
        self.remainders = distinct & ((np.uint64(1) << shift) - np.uint64(1))
        bounds = runs(quotients)
        self.slots = quotients[bounds[:-1]].astype(np.uint32)
        self.ends = bounds[1:].astype(np.uint32)

    def fingerprints(self) -> np.ndarray:
        lengths = np.diff(self.ends, prepend=np.uint32(0))
        return (np.repeat(self.slots.astype(np.uint64), lengths) << np.uint64(64 - self.bits)) | self.remainders

    def blocks(self, block_bits: int) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
        """The filter cut at quotient ranges: block number, slots, run ends, remainders, counts."""
        number = self.slots >> np.uint32(self.bits - block_bits)
        bounds = runs(number)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            first = int(self.ends[a - 1]) if a else 0
            last = int(self.ends[b - 1])
            yield (
                int(number[a]), self.slots[a:b].tobytes(), (self.ends[a:b] - np.uint32(first)).tobytes(),
                self.remainders[first:last].tobytes(), self.counts[first:last].astype(np.int64).tobytes(),
            )

    @classmethod
    def merged(cls, parts: list[tuple[bytes, bytes, bytes, bytes]], quotient_bits: int) -> QuotientFilter:
        """One filter of several blocks with the same number."""
        values, counts = [], []
        for slots, ends, remainders, count in parts:
            one = cls.__new__(cls)
            one.bits = quotient_bits
            one.slots, one.ends = np.frombuffer(slots, np.uint32), np.frombuffer(ends, np.uint32)
            one.remainders, one.counts = np.frombuffer(remainders, np.uint64), np.frombuffer(count, np.int64)
            values.append(one.fingerprints())
            counts.append(one.counts)
        return cls(np.concatenate(values), np.concatenate(counts), quotient_bits)


def repeated_fingerprints(keyed: DataFrame, rows: int) -> DataFrame:
    """(fp, n) of the fingerprints that occur more than once in column ``fp``."""
    spark = keyed.sparkSession
    block_bits = max(0, (tasks_for(spark, rows, BLOCK_ROWS) - 1).bit_length())
    quotient_bits = min(32, block_bits + 16)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [column(b, "fp").astype(np.int64).view(np.uint64) for b in batches]
        values = np.concatenate(seen) if seen else np.zeros(0, np.uint64)
        made = QuotientFilter(values, np.ones(len(values), np.int64), quotient_bits)
        if found := list(made.blocks(block_bits)):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], ["block", "slots", "ends", "remainders", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        parts = list(zip(*(table.column(c).to_pylist() for c in ("slots", "ends", "remainders", "counts")), strict=True))
        made = QuotientFilter.merged(parts, quotient_bits)
        many = made.counts > 1
        return pa.table({"fp": made.fingerprints()[many].view(np.int64), "n": made.counts[many]})

    filters = keyed.select("fp").mapInArrow(build, "block long, slots binary, ends binary, remainders binary, counts binary")
    return filters.groupBy("block").applyInArrow(merge, "fp long, n long")


def exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after white space is normalised; null is the empty
    text, so empty and null texts form one group. Of a group the smallest id stays; rows that
    repeat that very id stay with it. A null id sorts after all others and stays only in a group
    of null ids (its keep_id is null). An empty table gives no rows; other columns are ignored.
    """
    text_column = normalised(F.col(text))
    keyed = cut(
        docs.select(F.col(doc_id).alias("doc_id"), text_column.alias("_t")).select(
            "doc_id", F.xxhash64("_t").alias("fp"), F.sha2("_t", 256).alias("text_sha256"), F.octet_length("_t").alias("n_bytes")
        )
    )
    repeated = repeated_fingerprints(keyed, keyed.count())
    suspects = keyed.join(repeated.select("fp"), "fp", "left_semi")
    groups = (
        suspects.groupBy("text_sha256", "n_bytes")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1")
    )
    # cut first: a join straight after the aggregate would sit on its partitions and could not be split
    groups = cut(groups)
    if groups.count() <= SENT_IDS:
        groups = F.broadcast(groups)
    return keyed.join(groups, ["text_sha256", "n_bytes"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of equal texts, with all its columns: the one with the smallest id, and of
    rows that repeat this id (or have none, in a group of null ids) the smallest by all columns."""
    found = exact_copies(docs, doc_id, text)
    again = found.where("kept and group_size > 1").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    key = row_key(F.col(doc_id), normalised(F.col(text)))
    return without_rows(docs, key, found.where("not kept").select("doc_id", "text_sha256"), again)
