"""Queries a service asks of the decision tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide import schema as S
from flowtide.operators.assemble import packet_rows

REJECTED = ("reject", "forced_reject")
UNDECIDABLE = "undecidable"


def _decided() -> Column:
    return F.col("decision") != UNDECIDABLE


def _rate(cond: Column) -> Column:
    return F.avg(F.when(_decided(), cond.cast("double")))


def rolling_stats(decisions: DataFrame, window_s: float, now: float | Column) -> DataFrame:
    """Aggregates over the last ``window_s`` seconds; undecidable flows are counted apart and kept
    out of every rate. The time filter reaches the scan."""
    now = F.lit(float(now)) if not isinstance(now, Column) else now
    rows = decisions.where(F.col("decided_at") >= now - F.lit(float(window_s)))
    n = F.count(F.when(_decided(), 1))
    return rows.agg(
        n.alias("n"), F.count(F.when(~_decided(), 1)).alias("undecidable"), (n / F.lit(float(window_s))).alias("flows_per_s"),
        F.avg(F.when(_decided(), F.col("k"))).alias("mean_k"), _rate(F.col("decision") == "commit").alias("commit_rate"),
        _rate(F.col("decision").isin(*REJECTED)).alias("reject_rate"), _rate(F.col("forced")).alias("forced_rate"),
        F.avg(F.col("correct").cast("double")).alias("accuracy"),
        F.avg(F.when(_decided(), F.col("time_to_decision_ms"))).alias("mean_time_to_decision_ms"),
    )


def series(decisions: DataFrame, bucket_s: float, since: float | None = None) -> DataFrame:
    """Mean K, reject rate, threshold and accuracy per bucket of ``bucket_s`` seconds."""
    rows = decisions if since is None else decisions.where(F.col("decided_at") >= since)
    t = F.floor(F.col("decided_at") / F.lit(float(bucket_s))) * F.lit(float(bucket_s))
    return rows.groupBy(t.alias("t")).agg(
        F.count(F.when(_decided(), 1)).alias("n"), F.avg(F.when(_decided(), F.col("k"))).alias("mean_k"),
        _rate(F.col("decision").isin(*REJECTED)).alias("reject_rate"),
        F.avg(F.when(_decided(), F.col("theta_commit"))).alias("theta_commit"),
        F.avg(F.col("correct").cast("double")).alias("accuracy"),
    )


def recent_flows(flows: DataFrame, decisions: DataFrame, since: int, limit: int) -> DataFrame:
    """Decided flows after a decision id, newest first. The newest rows are picked before the join,
    so only ``limit`` decisions meet the flows."""
    newest = decisions.where(F.col("decision_id") > since).orderBy(F.col("decision_id").desc()).limit(limit)
    return flows.join(F.broadcast(newest), "flow_id").orderBy(F.col("decision_id").desc())


def rejected(flows: DataFrame, decisions: DataFrame, limit: int) -> DataFrame:
    return recent_flows(flows, decisions.where(F.col("decision").isin(*REJECTED)), -1, limit)


def k_histogram(decisions: DataFrame, only_rejected: bool = False, since: float | None = None) -> DataFrame:
    rows = decisions.where(F.col("decision").isin(*REJECTED)) if only_rejected else decisions
    if since is not None:
        rows = rows.where(F.col("decided_at") >= since)
    return rows.where("k > 0").groupBy("k").agg(F.count("*").alias("n"))


def controller_history(rows: DataFrame, n: int) -> DataFrame:
    """The last ``n`` controller windows, oldest first."""
    return rows.orderBy(F.col("window_id").desc()).limit(n).orderBy("window_id")


def drift_history(rows: DataFrame, signals: Sequence[str], n_windows: int) -> DataFrame:
    """The last windows, one row each: value and alarm of every signal."""
    top = rows.agg(F.max("window_id").alias("_top"))
    last = rows.crossJoin(F.broadcast(top)).where(F.col("window_id") > F.col("_top") - n_windows)
    pick = lambda s, c: F.max(F.when(F.col("signal") == s, F.col(c)))
    return last.groupBy("window_id").agg(
        *[pick(s, "value").alias(s) for s in signals], *[pick(s, "alarm").alias(f"{s}_alarm") for s in signals]
    ).orderBy("window_id")


def flow_detail(flows: DataFrame, decisions: DataFrame, trace: DataFrame, flow_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(flow with its decision, packets, trace) of one flow; the id filter reaches every scan."""
    one = F.col("flow_id") == flow_id
    flow = flows.where(one)
    return flow.join(decisions.where(one), "flow_id", "left"), packet_rows(flow), trace.where(one)


def periods_with_split(flows: DataFrame, splits: DataFrame) -> DataFrame:
    """Periods that exist and the split that claims them."""
    tags = splits.groupBy("period").agg(F.array_join(F.array_sort(F.collect_set("split")), ",").alias("split"))
    return flows.groupBy("period").agg(F.count("*").alias("n")).join(F.broadcast(tags), "period", "left")


def decision_names(code: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for kv in S.DECISIONS.items() for v in kv]), code)
