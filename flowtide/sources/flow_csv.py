"""Flow CSV files: allow-listed scan, nested sequence parse, verification, export."""

from __future__ import annotations

import lzma
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtide import schema as S
from flowtide.functions.draws import uniform
from flowtide.functions.labels import file_date, flag_mask, week_label

# fixed values: the 45 columns of the file, in file order
HEADER = (
    "ID SRC_IP DST_IP DST_ASN DST_PORT PROTOCOL TLS_SNI TLS_JA3 TIME_FIRST TIME_LAST DURATION BYTES"
    " BYTES_REV PACKETS PACKETS_REV PPI_LEN PPI_DURATION PPI_ROUNDTRIPS APP CATEGORY FLAG_CWR"
    " FLAG_CWR_REV FLAG_ECE FLAG_ECE_REV FLAG_URG FLAG_URG_REV FLAG_ACK FLAG_ACK_REV FLAG_PSH"
    " FLAG_PSH_REV FLAG_RST FLAG_RST_REV FLAG_SYN FLAG_SYN_REV FLAG_FIN FLAG_FIN_REV"
    " FLOW_ENDREASON_IDLE FLOW_ENDREASON_ACTIVE FLOW_ENDREASON_END FLOW_ENDREASON_OTHER PPI"
    " PHIST_SRC_SIZES PHIST_DST_SIZES PHIST_SRC_IPT PHIST_DST_IPT"
).split()

_TYPES = {
    "DURATION": T.DoubleType(),
    **{c: T.LongType() for c in ("BYTES", "BYTES_REV", "PACKETS", "PACKETS_REV")},
    **{c: T.IntegerType() for c in ("PROTOCOL", "PPI_LEN")},
    **{f"FLAG_{f}{r}": T.IntegerType() for f in S.FLAG_BITS for r in ("", "_REV")},
}

#: the columns that are ever read; identifier columns are not among them
READ = [
    "TIME_FIRST", "DURATION", "BYTES", "BYTES_REV", "PACKETS", "PACKETS_REV", "PPI_LEN", "PROTOCOL", "APP", "CATEGORY",
    *[f"FLAG_{f}{r}" for f in S.FLAG_BITS for r in ("", "_REV")],
    "PPI",
]

SCHEMA = T.StructType([T.StructField(c, _TYPES.get(c, T.StringType())) for c in HEADER])


def source_name() -> Column:
    """The ``flows-….csv`` part of the path a row was read from (a file or a folder of parts)."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"(flows-[^/]+?\.csv[^/]*?)(/part-[^/]*)?$", 1)


def scan(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Raw rows of the allow-listed columns plus ``source_file``.

    The parser only materialises the selected columns. Plain, gzip and bzip2 files go to Spark's reader; files
    named ``.xz`` are decompressed in the tasks, a block at a time. An empty file has no rows.
    """
    listed = [paths] if isinstance(paths, str) else list(paths)
    packed = [p for p in listed if p.endswith(".xz")]
    plain = [p for p in listed if not p.endswith(".xz")]
    parts = []
    if plain:
        raw = spark.read.schema(SCHEMA).option("header", True).option("enforceSchema", False).csv(plain)
        parts.append(raw.select(*READ, source_name().alias("source_file")))
    if packed:
        parts.append(_scan_xz(spark, packed))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


#: decompressed bytes a task takes at a time
XZ_BYTES = 1 << 22


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of xz files behind the header, which is checked."""
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            rest, header = b"", True
            with lzma.open(pa.BufferReader(content.as_buffer())) as file:
                while block := file.read(XZ_BYTES):
                    *lines, rest = (rest + block).split(b"\n")
                    yield from _checked(path, lines, header)
                    header = header and not lines
            yield from _checked(path, [rest] if rest else [], header)


def _checked(path: str, lines: list[bytes], header: bool) -> Iterator[pa.RecordBatch]:
    texts = [x.rstrip(b"\r").decode() for x in lines]
    if header and texts and texts.pop(0).split(",") != HEADER:
        raise ValueError(f"{path}: the header is not the one expected")
    texts = [t for t in texts if t]
    if texts:
        yield pa.RecordBatch.from_arrays([pa.array([path] * len(texts)), pa.array(texts)], ["path", "line"])


def _scan_xz(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")
    lines = files.mapInArrow(_lines, "path string, line string")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in SCHEMA)
    rows = lines.select(F.from_csv("line", fields).alias("r"), F.regexp_extract("path", r"(flows-[^/]+?\.csv[^/]*)$", 1).alias("source_file"))
    return rows.select(*[F.col(f"r.`{c}`").alias(c) for c in READ], "source_file")


def sample(raw: DataFrame, rate: float, seed: int) -> DataFrame:
    """Keep rows with probability ``rate`` before anything is parsed.

    The draw depends on seed, file and row content, so it does not depend on how files are cut.
    """
    if not 0.0 < rate <= 1.0:
        raise ValueError(f"rate must be in (0, 1], got {rate}")
    keys = [F.col("source_file"), *[F.col(c) for c in ("TIME_FIRST", "DURATION", "BYTES", "BYTES_REV", "APP", "PPI")]]
    return raw if rate == 1.0 else raw.where(uniform(seed, "csv-sample", *keys) < rate)


def parse_sequence(text: Column) -> Column:
    """``[[ipt],[dir],[size],[push]]`` to the packet array: first 30, gaps and sizes clipped."""
    lists = F.from_json(text, "array<array<int>>")
    zipped = F.arrays_zip(*[F.element_at(lists, i + 1).alias(n) for i, n in enumerate(("ipt", "dir", "size", "push"))])
    return F.transform(
        F.slice(zipped, 1, S.K_MAX),
        lambda p: F.struct(
            F.least(F.greatest(p["ipt"], F.lit(0)), F.lit(S.IPT_MAX)).alias("ipt"), p["dir"].alias("dir"),
            F.least(F.greatest(p["size"], F.lit(0)), F.lit(S.SIZE_MAX)).alias("size"), p["push"].alias("push"),
        ),
    )


def sequence_length(text: Column) -> Column:
    return F.size(F.element_at(F.from_json(text, "array<array<int>>"), 1))


def length_ok(declared: Column, parsed: Column) -> Column:
    """The declared length has to be the parsed one while it fits in 30."""
    return F.coalesce((declared > S.K_MAX) | (declared == parsed), F.lit(False))


def parse(raw: DataFrame, strict: bool = True) -> DataFrame:
    """Flows with sequence, flags, UTC start, day and period. Strict mode raises on a bad length."""
    rows = raw.withColumns(
        {
            "ppi": parse_sequence(F.col("PPI")),
            "_parsed": sequence_length(F.col("PPI")),
            "start": F.to_timestamp("TIME_FIRST"),
            "day": file_date(F.col("source_file")),
        }
    )
    good = length_ok(F.col("PPI_LEN"), F.col("_parsed"))
    if strict:
        rows = rows.withColumn(
            "ppi",
            F.when(good, F.col("ppi")).otherwise(
                F.raise_error(F.concat(F.lit("declared length differs from the sequence in "), F.col("source_file"))).cast(S.PPI)
            ),
        )
    flags = flag_mask({f: (F.col(f"FLAG_{f}"), F.col(f"FLAG_{f}_REV")) for f in S.FLAG_BITS})
    return rows.select(
        "source_file", "day", "start", F.unix_millis("start").alias("ts"), week_label(F.col("day")).alias("period"),
        F.col("DURATION").alias("duration"), F.col("BYTES").alias("bytes"), F.col("BYTES_REV").alias("bytes_rev"),
        F.col("PACKETS").alias("packets"), F.col("PACKETS_REV").alias("packets_rev"), F.col("PROTOCOL").alias("proto"),
        flags.alias("flags_seen"), F.col("APP").alias("app"), F.col("CATEGORY").alias("category_name"), "ppi",
        F.size("ppi").alias("ppi_len"), good.alias("length_ok"),
    )


def quarantine(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rows whose declared length is wrong) of a lenient parse."""
    return parsed.where("length_ok"), parsed.where("not length_ok")


def class_map(rows: DataFrame, col: str, name: str = "id") -> DataFrame:
    """(name, dense id) of the sorted distinct values over all files. A dictionary, a few hundred rows."""
    from pyspark.sql import Window as W

    return rows.select(F.col(col).alias("name")).where("name is not null").distinct().withColumn(
        name, F.row_number().over(W.orderBy("name")) - 1
    )


def export(
    flows: DataFrame, path: str, dataset: str, *, mode: str = "error", max_rows_per_file: int = 1_000_000
) -> dict[str, int]:
    """Write flows by (dataset, period), leaving out flows without recorded packets.

    Counters are observed in the same pass: rows read, rows dropped for an empty sequence.
    """
    seen = Observation("export")
    counted = flows.observe(
        seen,
        F.count(F.lit(1)).alias("rows_read"),
        F.count(F.when(F.col("ppi_len") == 0, 1)).alias("dropped_empty"),
    )
    (
        counted.where("ppi_len > 0").withColumn("dataset", F.lit(dataset))
        .write.mode(mode).option("maxRecordsPerFile", max_rows_per_file)
        .partitionBy("dataset", "period").parquet(path)
    )
    got = seen.get
    return {**got, "rows_written": got["rows_read"] - got["dropped_empty"]}


def verify_days(raw: DataFrame, stats: DataFrame) -> DataFrame:
    """Problems per file: row count against the recorded total, apps the record does not list.

    ``stats``: (source_file, total, apps ARRAY<STRING>), one row per file.
    """
    seen = raw.groupBy("source_file").agg(F.count("*").alias("rows"), F.collect_set("APP").alias("seen"))
    both = seen.join(stats, "source_file", "full_outer")
    extra = F.array_sort(F.array_except("seen", "apps"))
    problem = (
        F.when(F.col("total").isNull(), F.lit("no record for the file"))
        .when(F.col("rows").isNull(), F.lit("no rows for the record"))
        .when(F.col("rows") != F.col("total"), F.lit("row count differs"))
        .when(F.size(extra) > 0, F.lit("apps not in the record"))
    )
    return both.select(
        "source_file", "rows", "total", F.coalesce(extra, F.array().cast("array<string>")).alias("extra_apps"), problem.alias("problem")
    )


def read_stats(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Sidecar records ``{"global": {"total-saved": n}, "apps": {app: n}}`` as (source_file, total, apps)."""
    shape = "`global` struct<`total-saved`: bigint>, apps map<string,bigint>"
    raw = spark.read.schema(shape).option("multiLine", True).json(paths)
    day = F.regexp_extract(F.col("_metadata.file_path"), r"stats-(\d{8})", 1)
    return raw.select(
        F.concat(F.lit("flows-"), day, F.lit(".csv")).alias("source_file"),
        F.col("global.`total-saved`").alias("total"), F.map_keys("apps").alias("apps"),
    )


def assert_verified(problems: DataFrame) -> None:
    bad = problems.where("problem is not null").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['source_file']}: {bad[0]['problem']}")


def to_csv_rows(flows: DataFrame, app: Column, category: Column, file: Column) -> DataFrame:
    """Flows in the 45-column file layout plus ``file`` (used to make test files)."""
    ppi = F.to_json(F.array(*[F.col(f"ppi.{c}") for c in ("ipt", "dir", "size", "push")]))
    values: dict[str, Column] = {c: F.lit(None).cast("string") for c in HEADER}
    values |= {
        "ID": F.col("flow_id"), "PROTOCOL": F.col("proto"), "PPI_LEN": F.col("ppi_len"), "APP": app, "CATEGORY": category,
        "TIME_FIRST": F.date_format(F.timestamp_micros("start_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        "DURATION": (F.col("end_us") - F.col("start_us")) / F.lit(1e6),
        "BYTES": F.col("bytes"), "BYTES_REV": F.col("bytes_rev"), "PACKETS": F.col("packets"),
        "PACKETS_REV": F.col("packets_rev"), "PPI": ppi,
        **{c: F.lit("POISON") for c in ("SRC_IP", "DST_IP", "DST_ASN", "DST_PORT", "TLS_SNI", "TLS_JA3")},
        **{f"FLAG_{f}": (F.col("flags_seen").bitwiseAND(F.lit(b)) > 0).cast("int") for f, b in S.FLAG_BITS.items()},
        **{f"FLAG_{f}_REV": F.lit(0) for f in S.FLAG_BITS},
    }
    return flows.select(*[values[c].alias(c) for c in HEADER], file.alias("file"))
