"""Stored flows as a timed event stream, and files a stream can read in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtide.functions.draws import uniform

END = -1

EVENTS = T.StructType(
    [
        T.StructField("flow_id", T.LongType()), T.StructField("index", T.IntegerType()),
        T.StructField("event_time", T.TimestampType()), T.StructField("ipt", T.IntegerType()),
        T.StructField("dir", T.IntegerType()), T.StructField("size", T.IntegerType()),
        T.StructField("push", T.IntegerType()), T.StructField("label", T.IntegerType()),
    ]
)


def poisson_starts(flows: DataFrame, rate: float, seed: int, key: str = "flow_id") -> DataFrame:
    """Adds ``start_s``: arrival times of a Poisson stream, the running sum of exponential gaps."""
    from flowtide.operators.ordered import running_totals

    if rate <= 0:
        raise ValueError("rate must be positive")
    gap = -F.log(F.greatest(uniform(seed, "arrivals", F.col(key)), F.lit(2.0**-53))) / F.lit(float(rate))
    placed = running_totals(flows.withColumn("_gap", gap), [], [key], {"start_s": "_gap"})
    return placed.drop("_gap", "start_s_total")


def capture_starts(flows: DataFrame, speed: float = 1.0) -> DataFrame:
    """Adds ``start_s``: start relative to the first flow, sped up."""
    first = flows.agg(F.min("start_us").alias("_t0"))
    return flows.crossJoin(F.broadcast(first)).withColumn(
        "start_s", (F.col("start_us") - F.col("_t0")) / F.lit(1e6 * max(speed, 1e-9))
    ).drop("_t0")


def schedule(
    flows: DataFrame, *, speed: float = 1.0, max_gap_s: float = 0.5, epoch: str = "2024-01-01 00:00:00"
) -> DataFrame:
    """Packet events of flows: packet j is due at the start plus the capped gaps up to it, the END
    marker (index -1) a little later. A flow's events come from its own array; nothing is shuffled."""
    if speed <= 0:
        raise ValueError("speed must be positive")
    gap = lambda p: F.least(F.greatest(p["ipt"], F.lit(0)) / F.lit(1000.0 * speed), F.lit(float(max_gap_s)))
    due = F.transform(
        "ppi",
        lambda p, j: F.col("start_s") + F.aggregate(
            F.slice("ppi", F.lit(2), j), F.lit(0.0), lambda a, q: a + gap(q)
        ),
    )
    packets = F.transform(
        F.arrays_zip(F.col("ppi").alias("p"), due.alias("t")),
        lambda e, j: F.struct(j.alias("index"), e["t"].alias("t"), e["p"]["ipt"].alias("ipt"), e["p"]["dir"].alias("dir"),
                              e["p"]["size"].alias("size"), e["p"]["push"].alias("push")),
    )
    last = F.coalesce(F.element_at(F.col("_due"), -1), F.col("start_s")) + F.lit(0.05 / speed)
    null = F.lit(None).cast("int")
    end = F.array(F.struct(F.lit(END).alias("index"), last.alias("t"), null.alias("ipt"), null.alias("dir"), null.alias("size"), null.alias("push")))
    rows = flows.withColumn("_due", F.when(F.size("ppi") > 0, due)).select("flow_id", "label", F.explode(F.concat(packets, end)).alias("e"))
    base = F.unix_micros(F.lit(epoch).cast("timestamp"))
    return rows.select(
        "flow_id", F.col("e.index").alias("index"),
        F.timestamp_micros(base + F.floor(F.col("e.t") * 1e6).cast("bigint")).alias("event_time"),
        "e.ipt", "e.dir", "e.size", "e.push", "label",
    )


#: rows of a slice that go to one file
FILE_ROWS = 100_000


def write_in_order(events: DataFrame, path: str, by: Column, batches: int, key: str | None = None) -> int:
    """Write events in ``batches`` slices whose files' age follows ``by``; the number of files of a slice.

    With a ``key`` its rows share a file inside a slice, and every slice has the same number of files, so a stream
    that takes that many at a time takes a slice per micro-batch: every key's rows come in order, no row comes
    after the watermark of its own slice, and the number of micro-batches does not depend on the rows. Without
    one a slice is one file and ``batches`` has to keep it small.
    """
    v = by.cast("double")
    probs = [i / batches for i in range(1, batches)]
    edges = F.percentile_approx(v, probs, 1000) if probs else F.lit(None)
    n, found = events.agg(F.count("*"), edges).first()
    files = max(1, -(-n // (batches * FILE_ROWS))) if key else 1
    lows: Sequence[float | None] = [None, *(found or [])]
    highs: Sequence[float | None] = [*(found or []), None]
    for lo, hi in zip(lows, highs, strict=True):
        part = events
        if lo is not None:
            part = part.where(v > lo)
        if hi is not None:
            part = part.where(v <= hi)
        before = _files(events.sparkSession, path)
        (part.repartition(files, key) if key else part.repartition(1)).write.mode("append").parquet(path)
        # a task without rows writes no file
        for _ in range(_files(events.sparkSession, path) - before, files if key else 0):
            events.limit(0).repartition(1).write.mode("append").parquet(path)
    return files


def _files(spark: SparkSession, path: str) -> int:
    """Data files in a folder; 0 without the folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sum(f.getPath().getName().startswith("part-") for f in fs.listStatus(where)) if fs.exists(where) else 0


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """File stream; the number of files a batch may take is the back-pressure limit."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
