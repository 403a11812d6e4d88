"""Binary files of bounded size, written and read through Spark's own file sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_blobs(blobs: DataFrame, path: str, magic: bytes) -> None:
    """Write each value of the binary column ``blob`` to a file of its own, followed by ``magic``.

    The text source writes the bytes of a string as they are, and its line separator after them;
    the separator is the closing magic number of the format. Spark's commit protocol names the
    files, so a task that runs twice leaves one copy.
    """
    (
        blobs.select(F.col("blob").cast("string"))
        .write.option("encoding", "ISO-8859-1")
        .option("lineSep", magic.decode("latin-1"))
        .option("maxRecordsPerFile", 1)
        .option("compression", "none")
        .text(path)
    )


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every file, one file per row."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
