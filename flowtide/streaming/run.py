"""Running a stream over what is there, into tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from flowtide.session import ROCKSDB, scratch_path


def use_rocksdb(spark: SparkSession) -> None:
    """State lives in RocksDB with checkpoints in the query's own folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process all available input into a Parquet table (exactly-once file sink); read it back."""
    spark = stream.sparkSession
    use_rocksdb(spark)
    path = scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode(mode).trigger(availableNow=True)
        .option("path", path).option("checkpointLocation", path + "-state").start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def write_tables(tables: Mapping[str, Callable[[DataFrame], DataFrame]], path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that writes several tables in the order given.

    Every batch replaces its own folder, so a batch that is run again leaves no duplicates and an
    interrupted one is completed: nothing is lost and nothing is counted twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for name, pick in tables.items():
                pick(batch).write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        finally:
            batch.unpersist()

    return write


def run_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], name: str, mode: str = "append") -> None:
    spark = stream.sparkSession
    use_rocksdb(spark)
    state = scratch_path(spark, name + "-state")
    query = (
        stream.writeStream.foreachBatch(sink).outputMode(mode).trigger(availableNow=True)
        .option("checkpointLocation", state).start()
    )
    query.awaitTermination()


def isolated(hooks: list[Callable[[DataFrame, int], None]], errors: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """Call every listener of a batch; one that fails does not stop the others or the stream."""

    def call(batch: DataFrame, batch_id: int) -> None:
        for hook in hooks:
            try:
                hook(batch, batch_id)
            except Exception as e:  # noqa: BLE001
                if errors is not None:
                    errors.append(f"batch {batch_id}: {e}")

    return call


class Throughput(StreamingQueryListener):
    """Batch durations and rows of the running streams: p50 and p95 in milliseconds."""

    def __init__(self) -> None:
        self.batch_ms: list[float] = []
        self.rows = 0

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.rows += p.numInputRows
        if p.numInputRows:
            self.batch_ms.append(float(p.durationMs.get("triggerExecution", 0)))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def counters(self) -> dict[str, float]:
        ms = sorted(self.batch_ms)
        at = lambda q: ms[min(int(q * len(ms)), len(ms) - 1)] if ms else 0.0
        return {"batches": float(len(ms)), "rows": float(self.rows), "p50_ms": at(0.5), "p95_ms": at(0.95)}
