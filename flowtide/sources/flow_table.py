"""The flow table: guarded writes, pruned scans, audit sidecar, completeness, file manifest."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.functions.draws import uniform
from flowtide.functions.labels import salted_hash
from flowtide.session import cut
from flowtide.sources.captures import HELD_BYTES, Opened

#: schemes of file systems that a task opens itself
STREAMED = {"file", "hdfs", "s3", "gs"}
RESERVED_META = ("dataset", "period", "n_flows", "file_rows", "counters")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and len(fs.listStatus(p)) > 0


def write(
    flows: DataFrame, path: str, *, overwrite: bool = False, allow_unknown: bool = False,
    rows_per_file: int = 1_000_000, meta: dict[str, str] | None = None,
) -> DataFrame:
    """Write flows by (dataset, period) and return what was written, one row per file.

    Refuses a non-empty target unless ``overwrite``, label -1 unless ``allow_unknown``, and extra
    meta keys that are reserved. Flows without packets are left out.
    """
    spark = flows.sparkSession
    clash = set(meta or {}) & set(RESERVED_META)
    if clash:
        raise ValueError(f"reserved meta keys: {sorted(clash)}")
    if not overwrite and _exists(spark, path):
        raise FileExistsError(f"{path} is not empty")
    good = flows.where("ppi_len > 0")
    if not allow_unknown:
        n = good.where("label < 0").count()
        if n:
            raise ValueError(f"{n} flows have an unknown label")
    (
        good.write.mode("overwrite" if overwrite else "error").option("maxRecordsPerFile", rows_per_file)
        .partitionBy("dataset", "period").parquet(path)
    )
    return file_rows(spark, path)


def scan(spark: SparkSession, path: str, periods: Sequence[str] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Flows of some periods (partition pruning) and columns (column pruning)."""
    rows = spark.read.parquet(path)
    if periods is not None:
        rows = rows.where(F.col("period").isin(list(periods)))
    return rows.select(*columns) if columns is not None else rows


def shuffled_batches(flows: DataFrame, batch: int, seed: int, key: str = "flow_id") -> DataFrame:
    """Rows in a seeded random order, numbered by batch; at most ``batch`` rows per batch id.

    Rows are spread by a range of the draw, so every task orders only its own share.
    """
    from flowtide.operators.ordered import global_row_number

    drawn = flows.withColumn("_d", uniform(seed, "batches", F.col(key)))
    placed = global_row_number(drawn, ["_d", key], "_rn")
    return placed.withColumn("batch_id", F.floor((F.col("_rn") - 1) / batch)).drop("_d", "_rn", "_rn_total")


def file_rows(spark: SparkSession, path: str) -> DataFrame:
    """(period, file, n, n_bad) as the files are now; ``n_bad`` counts rows with a missing column."""
    rows = spark.read.parquet(path)
    must = [c for c in ("flow_id", "ppi", "ppi_len", "label") if c in rows.columns]
    missing = F.lit(False)
    for c in must:
        missing = missing | F.col(c).isNull()
    return rows.groupBy("period", F.col("_metadata.file_name").alias("file")).agg(
        F.count("*").alias("n"), F.count(F.when(missing, 1)).alias("n_bad")
    )


def audit(recorded: DataFrame, actual: DataFrame, flows_recorded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(problems, healthy flows per period): files gone, files not recorded, wrong counts, rows
    with missing columns, file rows that do not add up to the recorded flows of the period."""
    r = recorded.select("period", "file", F.col("n").alias("recorded"))
    a = actual.select("period", "file", F.col("n").alias("found"), "n_bad")
    per_file = r.join(a, ["period", "file"], "full_outer").select(
        "period", "file",
        F.when(F.col("found").isNull(), F.lit("missing file"))
        .when(F.col("recorded").isNull(), F.lit("file not recorded"))
        .when(F.col("found") != F.col("recorded"), F.lit("row count differs"))
        .when(F.col("n_bad") > 0, F.lit("missing values")).alias("problem"),
    )
    sums = recorded.groupBy("period").agg(F.sum("n").alias("s"))
    per_period = sums.join(flows_recorded, "period", "full_outer").select(
        "period", F.lit(None).cast("string").alias("file"),
        F.when(~F.col("s").eqNullSafe(F.col("n_flows")), F.lit("file rows do not add up")).alias("problem"),
    )
    problems = per_file.unionByName(per_period).where("problem is not null")
    healthy = flows_recorded.join(problems.select("period").distinct(), "period", "left_anti")
    return problems, healthy


def audit_rows(flows: DataFrame, salt: str, key: str = "flow_key") -> DataFrame:
    """The audit sidecar: salted hash of the key (NULL without one), start, reason, session."""
    return flows.where("ppi_len > 0").select(
        "flow_id", salted_hash(F.col(key), salt).alias("key_hash"), F.floor(F.col("start_us") / 1000).alias("start_ts"),
        "end_reason", "session_id",
    )


# --- manifest --------------------------------------------------------------------------------------


def file_hashes(spark: SparkSession, paths: str | Sequence[str], glob: str = "*") -> DataFrame:
    """(name, bytes, sha256) of files, hashed where they are read: as streams of a few MB where Arrow can open the
    file system, else (a store that only Spark reads) one value a file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(paths)
    listed = cut(files.select("path", "length"))
    schemes = [r[0] for r in listed.select(F.regexp_extract("path", "^([a-z0-9]+):", 1)).distinct().collect()]
    if set(schemes) <= STREAMED:
        rows, content = listed.repartition(max(1, min(listed.count(), 100_000))), False
    else:
        rows, content = files.select("path", "length", "content"), True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            digests = []
            for i, path in enumerate(b.column("path").to_pylist()):
                if content:
                    digests.append(hashlib.sha256(b.column("content")[i].as_buffer()).hexdigest())
                    continue
                made, file = hashlib.sha256(), Opened(path).file
                while part := file.read(HELD_BYTES):
                    made.update(part)
                digests.append(made.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("length"), pa.array(digests, pa.string())], names=["path", "length", "h"])

    return rows.mapInArrow(run, "path string, length bigint, h string").select(
        F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.col("h").alias("sha256")
    )


def merge(manifest: DataFrame, pulled: DataFrame) -> DataFrame:
    """Entries by name; a file pulled again replaces its entry."""
    kept = manifest.join(pulled.select("name"), "name", "left_anti")
    return kept.unionByName(pulled)


def verify(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """(name, status): ok, missing, changed or not registered."""
    m = manifest.select("name", F.col("sha256").alias("_m"))
    f = found.select("name", F.col("sha256").alias("_f"))
    return m.join(f, "name", "full_outer").select(
        "name",
        F.when(F.col("_f").isNull(), F.lit("missing")).when(F.col("_m").isNull(), F.lit("not registered"))
        .when(F.col("_m") != F.col("_f"), F.lit("changed")).otherwise(F.lit("ok")).alias("status"),
    )


def require(manifest: DataFrame, name: str, hint: str = "") -> dict:
    got = manifest.where(F.col("name") == name).limit(1).collect()
    if not got:
        raise KeyError(f"no manifest entry for {name!r}. {hint}".strip())
    return got[0].asDict()
