"""Stored decisions that a service asks: a table by day, and sums per minute beside it.

Both are Parquet below one folder, partitioned by the day of the decision and the batch that wrote it. Inside a
day rows lie in the order of their time, so a window reads the files of its days and few of their row groups. The
sums are additive: whole minutes are answered from them, and only the minute that a window begins in
is read from the decisions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.operators.serving import REJECTED, UNDECIDABLE

MINUTE_S, DAY_S = 60.0, 86400.0



def _values() -> dict[str, Column]:
    decided = F.col("decision") != UNDECIDABLE
    of = {
        "k": F.col("k"), "commit": F.col("decision") == "commit", "reject": F.col("decision").isin(*REJECTED), "forced": F.col("forced"),
        "time_to_decision_ms": F.col("time_to_decision_ms"), "theta_commit": F.col("theta_commit"),
    }
    return {name: F.when(decided, value.cast("bigint" if name in ("k", "commit", "reject", "forced") else "double")) for name, value in of.items()}


def minute_sums(decisions: DataFrame) -> DataFrame:
    """Additive sums by (day, minute, k, rejected): rows, decided and undecidable flows, and a sum and a count per mean.

    At most 62 rows a minute with K up to 30. Undecidable flows are in no mean but accuracy; rows without a
    time have no minute and are in no window.
    """
    decided = F.col("decision") != UNDECIDABLE
    values = {**_values(), "correct": F.col("correct").cast("bigint")}
    keys = [
        F.floor(F.col("decided_at") / DAY_S).cast("int").alias("day"), F.floor(F.col("decided_at") / MINUTE_S).cast("bigint").alias("minute"),
        F.col("k").cast("int").alias("k"), F.col("decision").isin(*REJECTED).alias("rejected"),
    ]
    return decisions.where("decided_at is not null").groupBy(*keys).agg(
        F.count("*").alias("rows"), F.count(F.when(decided, 1)).alias("n"), F.count(F.when(~decided, 1)).alias("undecidable"),
        *[F.sum(v).alias(f"sum_{name}") for name, v in values.items()], *[F.count(v).alias(f"n_{name}") for name, v in values.items()],
    )


def _total(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0).cast("bigint"))


def _mean(name: str) -> Column:
    return F.try_divide(F.sum(f"sum_{name}").cast("double"), F.sum(f"n_{name}"))


class DecisionStore:
    """Decisions (flow_id, decision_id, k, decided_at in seconds, decision, forced, correct, time_to_decision_ms, theta_commit; more
    columns are kept, but for ones named day or batch) and their sums per minute, below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def write(self, decisions: DataFrame, batch_id: int = 0) -> None:
        """Store a batch. Writing a batch again replaces it, so it can be the sink of a stream.

        A day is dealt over tasks by time, and one moment with many decisions by their ids.
        """
        rows = decisions.withColumn("day", F.floor(F.col("decided_at") / DAY_S).cast("int")).withColumn("batch", F.lit(batch_id).cast("bigint"))
        rows = rows.repartitionByRange("day", "decided_at", "decision_id").sortWithinPartitions("day", "decided_at")
        sums = minute_sums(decisions).withColumn("batch", F.lit(batch_id).cast("bigint"))
        sums = sums.repartitionByRange("day", "minute").sortWithinPartitions("day", "minute")
        for table, name in ((rows, "decisions"), (sums, "minutes")):
            table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{self.folder}/{name}")

    def _days(self, name: str, since: float | None) -> DataFrame:
        table = self.spark.read.parquet(f"{self.folder}/{name}")
        return table if since is None else table.where(F.col("day") >= int(since // DAY_S))

    def decisions(self, since: float | None = None) -> DataFrame:
        """The decisions from ``since`` on; days before it are not read."""
        rows = self._days("decisions", since).drop("day", "batch")
        return rows if since is None else rows.where(F.col("decided_at") >= float(since))

    def sums(self, since: float | None = None) -> DataFrame:
        """Sums of the decisions from ``since`` on: whole minutes as stored, the minute that ``since`` cuts from its decisions."""
        stored = self._days("minutes", since).drop("batch")
        if since is None:
            return stored
        first = -int(-since // MINUTE_S)
        whole = stored.where(F.col("minute") >= first)
        if first * MINUTE_S == since:
            return whole
        edge = self._days("decisions", since).where((F.col("decided_at") >= float(since)) & (F.col("decided_at") < first * MINUTE_S))
        # the cut minute lies in one day
        edge = edge.where(F.col("day") <= int(since // DAY_S))
        return whole.unionByName(minute_sums(edge))

    def rolling_stats(self, window_s: float, now: float) -> DataFrame:
        """As ``serving.rolling_stats`` over the stored decisions."""
        return self.sums(float(now) - float(window_s)).agg(
            _total("n").alias("n"), _total("undecidable").alias("undecidable"), (_total("n") / F.lit(float(window_s))).alias("flows_per_s"),
            _mean("k").alias("mean_k"), _mean("commit").alias("commit_rate"), _mean("reject").alias("reject_rate"), _mean("forced").alias("forced_rate"),
            _mean("correct").alias("accuracy"), _mean("time_to_decision_ms").alias("mean_time_to_decision_ms"),
        )

    def series(self, bucket_s: float, since: float | None = None) -> DataFrame:
        """As ``serving.series``. Buckets of whole minutes are added up from the sums, others from the decisions."""
        if bucket_s % MINUTE_S:
            from flowtide.operators.serving import series

            return series(self.decisions(since), bucket_s)
        t = F.floor(F.col("minute") * MINUTE_S / F.lit(float(bucket_s))) * F.lit(float(bucket_s))
        return self.sums(since).groupBy(t.alias("t")).agg(
            _total("n").alias("n"), _mean("k").alias("mean_k"), _mean("reject").alias("reject_rate"), _mean("theta_commit").alias("theta_commit"),
            _mean("correct").alias("accuracy"),
        )

    def k_histogram(self, only_rejected: bool = False, since: float | None = None) -> DataFrame:
        """As ``serving.k_histogram``, from the sums."""
        rows = self.sums(since).where("k > 0")
        return (rows.where("rejected") if only_rejected else rows).groupBy("k").agg(F.sum("rows").alias("n"))
