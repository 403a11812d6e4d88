"""Helpers the operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.session import cut

#: rows and bytes of one Arrow batch that a Python worker holds at a time
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches: texts are long, and a worker holds a whole batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def whole(text: Column) -> Column:
    """The text with null as the empty text."""
    return F.coalesce(text.cast("string"), F.lit(""))


def utf8(text: Column) -> Column:
    """The bytes of a text; null counts as empty."""
    return whole(text).cast("binary")


def tasks_for(spark: SparkSession, size: int, each: int) -> int:
    """How many tasks share ``size`` rows or bytes when one takes about ``each``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each), 1)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: keys that are broadcast at most; more are joined by a shuffle
SENT_IDS = 1 << 18


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """What tells rows apart where ids are null or repeat: the id and the text's SHA-256."""
    return [doc_id.alias("_id"), F.sha2(text, 256).alias("_sha")]


def without_rows(docs: DataFrame, key: list[Column], gone: DataFrame, again: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` whose ``row_key`` is not a row of ``gone``; a null id equals a null id. Of the
    rows that share a key in ``again`` one stays, the smallest by all columns from left to right."""
    names = docs.columns
    keyed = docs.select(F.struct("*").alias("_row"), *key)

    def with_key(rows: DataFrame, how: str) -> DataFrame:
        keys = cut(rows.toDF("_gone_id", "_gone_sha").distinct())
        if keys.count() <= SENT_IDS:
            keys = F.broadcast(keys)
        return keyed.join(keys, keyed["_id"].eqNullSafe(keys["_gone_id"]) & (keyed["_sha"] == keys["_gone_sha"]), how)

    if again is not None:
        again = cut(again)
        if not again.isEmpty():
            one = with_key(again, "left_semi").groupBy("_id", "_sha").agg(F.min("_row").alias("_row"))
            return with_key(gone.unionAll(again), "left_anti").select("_row").unionAll(one.select("_row")).select("_row.*").toDF(*names)
    return with_key(gone, "left_anti").select("_row.*").toDF(*names)


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column without nulls as an array."""
    return batch.column(name).to_numpy(zero_copy_only=False)


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the end: n runs give n + 1 numbers."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    new = np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1
    return np.concatenate(([0], new, [len(sorted_values)]))


def grouped_rows(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Cut the batches of a partition sorted by ``key`` so that no key's rows lie on both sides of
    a cut: each record batch handed on holds all rows of its keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = column(batch, key)
        last = int(np.searchsorted(keys, keys[-1], side="left"))
        if last:
            yield _joined([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        elif held and column(held[-1], key)[0] != keys[0]:
            yield _joined(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
