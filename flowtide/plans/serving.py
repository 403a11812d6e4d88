"""Queries a service asks, over decisions derived from the event flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide import schema as S
from flowtide.functions import ppi as P
from flowtide.operators import policies as H
from flowtide.operators import scores as C
from flowtide.operators import serving as V
from flowtide.operators import splits as SP
from flowtide.plans import sql as Q
from flowtide.plans.inputs import em_scores, ev_flows
from flowtide.plans.policies import reject_theta, safe_sql
from flowtide.plans.registry import SQL, query
from flowtide.plans.splits import SPEC
from flowtide.session import cut, scratch_path
from flowtide.sources.decision_store import DecisionStore

DECISIONS_SQL = Q.flows_sql() + f""", dr AS (SELECT *, {Q.reason_sql()} AS end_reason FROM fl),
tt AS (SELECT flow_id, sum(ipt) AS t FROM pp GROUP BY flow_id),
dc AS MATERIALIZED (SELECT f.flow_id, f.flow_id AS decision_id, f.ppi_len AS k, f.end_us / 1000000.0::DOUBLE AS decided_at,
 CASE WHEN f.ppi_len = 0 THEN 'undecidable' WHEN end_reason = 'rst' THEN 'reject' WHEN end_reason IN ('idle', 'fin') THEN 'commit' WHEN end_reason = 'active' THEN 'forced_commit' ELSE 'forced_reject' END AS decision,
 end_reason IN ('active', 'eof') AS forced, CASE WHEN f.label <> 6 THEN f.flow_key % 3 = 0 END AS correct, CAST(coalesce(tt.t, 0) AS DOUBLE) AS time_to_decision_ms,
 0.5::DOUBLE + (f.flow_key % 10) / 103.0::DOUBLE AS theta_commit FROM dr f LEFT JOIN tt USING (flow_id))"""


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    f = ev_flows(spark, sf)
    reason = F.col("end_reason")
    name = (
        F.when(F.col("ppi_len") == 0, F.lit("undecidable")).when(reason == "rst", F.lit("reject"))
        .when(reason.isin("idle", "fin"), F.lit("commit")).when(reason == "active", F.lit("forced_commit")).otherwise(F.lit("forced_reject"))
    )
    return f.select(
        "flow_id", F.col("flow_id").alias("decision_id"), F.col("ppi_len").alias("k"), (F.col("end_us") / 1e6).alias("decided_at"),
        name.alias("decision"), reason.isin("active", "eof").alias("forced"),
        F.when(F.col("label") != 6, F.col("flow_key") % 3 == 0).alias("correct"),
        P.total(F.col("ppi"), lambda p: p["ipt"]).cast("double").alias("time_to_decision_ms"),
        (F.lit(0.5) + (F.col("flow_key") % 10) / F.lit(103.0)).alias("theta_commit"),
    )


@query(
    "rolling_stats",
    DECISIONS_SQL + """, w AS (SELECT *, decision <> 'undecidable' AS ok FROM dc WHERE decided_at >= 1706572800.0::DOUBLE - 259200.0::DOUBLE)
SELECT CAST(count(*) FILTER (ok) AS BIGINT) AS n, CAST(count(*) FILTER (NOT ok) AS BIGINT) AS undecidable, round(count(*) FILTER (ok) / 259200.0::DOUBLE, 9) AS flows_per_s, round(avg(k) FILTER (ok), 6) AS mean_k,
 round(avg(CASE WHEN decision = 'commit' THEN 1.0::DOUBLE ELSE 0 END) FILTER (ok), 6) AS commit_rate, round(avg(CASE WHEN decision IN ('reject', 'forced_reject') THEN 1.0::DOUBLE ELSE 0 END) FILTER (ok), 6) AS reject_rate,
 round(avg(CASE WHEN forced THEN 1.0::DOUBLE ELSE 0 END) FILTER (ok), 6) AS forced_rate, round(avg(CASE WHEN correct THEN 1.0::DOUBLE WHEN NOT correct THEN 0 END), 6) AS accuracy,
 round(avg(time_to_decision_ms) FILTER (ok), 6) AS mean_time_to_decision_ms FROM w""",
)
def rolling_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = V.rolling_stats(decisions(spark, sf), 259200.0, 1706572800.0)
    digits = {"flows_per_s": 9}
    return out.select(*[c if c in ("n", "undecidable") else F.round(c, digits.get(c, 6)).alias(c) for c in out.columns])


@query(
    "decision_series",
    DECISIONS_SQL + """ SELECT floor(decided_at / 21600.0::DOUBLE) * 21600.0::DOUBLE AS t, CAST(count(*) FILTER (decision <> 'undecidable') AS BIGINT) AS n, round(avg(k) FILTER (decision <> 'undecidable'), 6) AS mean_k,
 round(avg(CASE WHEN decision IN ('reject', 'forced_reject') THEN 1.0::DOUBLE ELSE 0 END) FILTER (decision <> 'undecidable'), 6) AS reject_rate, round(avg(theta_commit) FILTER (decision <> 'undecidable'), 6) AS theta_commit,
 round(avg(CASE WHEN correct THEN 1.0::DOUBLE WHEN NOT correct THEN 0 END), 6) AS accuracy FROM dc GROUP BY 1""",
)
def decision_series(spark: SparkSession, sf: str) -> DataFrame:
    out = V.series(decisions(spark, sf), 21600.0)
    return out.select("t", "n", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("t", "n")])


@query(
    "recent_flows",
    DECISIONS_SQL + " SELECT dc.decision_id, fl.flow_key, fl.start_us, dc.decision, dc.k FROM dc JOIN fl USING (flow_id) WHERE decision_id > 4000 ORDER BY decision_id DESC LIMIT 100",
)
def recent_flows(spark: SparkSession, sf: str) -> DataFrame:
    f = ev_flows(spark, sf).select("flow_id", "flow_key", "start_us")
    out = V.recent_flows(f, decisions(spark, sf), 4000, 100)
    return out.select("decision_id", "flow_key", "start_us", "decision", "k")


@query(
    "rejected_flows",
    DECISIONS_SQL + " SELECT dc.decision_id, fl.flow_key, dc.decision FROM dc JOIN fl USING (flow_id) WHERE decision IN ('reject', 'forced_reject') ORDER BY decision_id DESC LIMIT 50",
)
def rejected_flows(spark: SparkSession, sf: str) -> DataFrame:
    f = ev_flows(spark, sf).select("flow_id", "flow_key")
    return V.rejected(f, decisions(spark, sf), 50).select("decision_id", "flow_key", "decision")


@query(
    "decision_k_histograms",
    DECISIONS_SQL + " SELECT 'decision' AS what, k, CAST(count(*) AS BIGINT) AS n FROM dc WHERE k > 0 GROUP BY k UNION ALL SELECT 'rejection', k, CAST(count(*) AS BIGINT) FROM dc WHERE k > 0 AND decision IN ('reject', 'forced_reject') GROUP BY k",
)
def decision_k_histograms(spark: SparkSession, sf: str) -> DataFrame:
    d = decisions(spark, sf)
    a = V.k_histogram(d).select(F.lit("decision").alias("what"), "k", "n")
    return a.unionByName(V.k_histogram(d, only_rejected=True).select(F.lit("rejection").alias("what"), "k", "n"))


def stored(spark: SparkSession, sf: str) -> DecisionStore:
    """The decisions, stored in two batches."""
    store = DecisionStore(spark, scratch_path(spark, "decisions"))
    d = cut(decisions(spark, sf))
    early = F.col("decided_at") < 1706400000.0
    store.write(d.where(early), 0)
    store.write(d.where(~early), 1)
    return store


#: a window that begins inside a minute
STORED_NOW, STORED_WINDOW = 1706572817.5, 1209600.0
STORED_SINCE = STORED_NOW - STORED_WINDOW


@query("stored_rolling_stats", SQL["rolling_stats"].replace("1706572800.0", repr(STORED_NOW)).replace("259200.0", repr(STORED_WINDOW)))
def stored_rolling_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = stored(spark, sf).rolling_stats(STORED_WINDOW, STORED_NOW)
    return out.select(*[c if c in ("n", "undecidable") else F.round(c, 9 if c == "flows_per_s" else 6).alias(c) for c in out.columns])


@query("stored_series", SQL["decision_series"].replace("FROM dc GROUP BY 1", f"FROM dc WHERE decided_at >= {STORED_SINCE!r}::DOUBLE GROUP BY 1"))
def stored_series(spark: SparkSession, sf: str) -> DataFrame:
    out = stored(spark, sf).series(21600.0, STORED_SINCE)
    return out.select("t", "n", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("t", "n")])


@query("stored_k_histograms", SQL["decision_k_histograms"])
def stored_k_histograms(spark: SparkSession, sf: str) -> DataFrame:
    s = stored(spark, sf)
    a = s.k_histogram().select(F.lit("decision").alias("what"), "k", "n")
    return a.unionByName(s.k_histogram(only_rejected=True).select(F.lit("rejection").alias("what"), "k", "n"))


@query(
    "controller_history",
    """WITH w AS (SELECT event_id // 100 AS window_id, avg(value) AS observed FROM events GROUP BY 1) SELECT CAST(window_id AS BIGINT) AS window_id, round(observed, 4) AS observed FROM w ORDER BY window_id DESC LIMIT 20""",
)
def controller_history(spark: SparkSession, sf: str) -> DataFrame:
    from flowtide import bindings as B

    rows = B.table(spark, sf, "events").groupBy(F.floor(F.col("event_id") / 100).cast("bigint").alias("window_id")).agg(F.avg("value").alias("observed"))
    return V.controller_history(rows, 20).select("window_id", F.round("observed", 4).alias("observed"))


@query("drift_history")
def drift_history(spark: SparkSession, sf: str) -> DataFrame:
    from flowtide.operators import drift as D
    from flowtide.plans.drift import EV_SIGNALS, ev_series

    series = ev_series(spark, sf)
    ref = D.reference_moments(series.where("window_id < 8"), EV_SIGNALS)
    rows, _ = D.monitor(series, ref, EV_SIGNALS, 3.0)
    return V.drift_history(rows, EV_SIGNALS, 6)


@query(
    "flow_detail",
    DECISIONS_SQL + " SELECT pp.flow_id, pp.j, pp.size, pp.dir, dc.decision FROM pp JOIN dc USING (flow_id) WHERE pp.flow_id = (SELECT max(flow_id) FROM fl WHERE ppi_len >= 3)",
)
def flow_detail(spark: SparkSession, sf: str) -> DataFrame:
    flows = ev_flows(spark, sf)
    which = flows.where("ppi_len >= 3").agg(F.max("flow_id")).first()[0]
    flow, packets, _ = V.flow_detail(flows, decisions(spark, sf).select("flow_id", "decision"), flows, which)
    return packets.join(flow.select("flow_id", "decision"), "flow_id").select("flow_id", "j", "size", "dir", "decision")


NAMED = "CASE decision " + " ".join(f"WHEN {code} THEN '{name}'" for code, name in S.DECISIONS.items()) + " END"


@query(
    "score_one_flow",
    Q.EM_SCORES + f""", {Q.theta_sql(0.1)}, {safe_sql(where='flow_id = 4')}
SELECT su.k, pred, round(p_safe, 6) AS p_safe, round(u, 6) AS u, de.k AS decided_k, {NAMED} AS decision, prediction FROM su, de WHERE su.flow_id = 4 AND su.k <= su.ppi_len""",
)
def score_one_flow(spark: SparkSession, sf: str) -> DataFrame:
    """Every prefix of one flow, and where and how it is decided first."""
    s = em_scores(spark, sf)
    one = s.where("flow_id = 4")
    rows = C.reached(C.long_scores(one, ["pred", "p_safe", "u"], ["flow_id", "ppi_len"]))
    first = H.safe_stop(one, 0.5, reject_theta(s)).select("flow_id", F.col("k").alias("decided_k"), V.decision_names(F.col("decision")).alias("decision"), "prediction")
    out = rows.join(F.broadcast(first), "flow_id")
    return out.select("k", "pred", F.round("p_safe", 6).alias("p_safe"), F.round("u", 6).alias("u"), "decided_k", "decision", "prediction")


@query(
    "decision_trace",
    Q.EM_SCORES + f", {Q.theta_sql(0.1)}, {safe_sql()} SELECT su.flow_id, su.k, pred, p_safe, u, {NAMED} AS decision FROM su JOIN de ON de.flow_id = su.flow_id AND su.k <= de.k",
)
def decision_trace(spark: SparkSession, sf: str) -> DataFrame:
    """Every prefix a decided flow was scored at, up to its decision."""
    s = em_scores(spark, sf)
    d = H.safe_stop(s.where("split = 'test'"), 0.5, reject_theta(s)).select("flow_id", F.col("k").alias("k_end"), "decision")
    rows = C.long_scores(s.where("split = 'test'"), ["pred", "p_safe", "u"], ["flow_id"])
    out = rows.join(d, "flow_id").where("k <= k_end")
    return out.select("flow_id", "k", "pred", "p_safe", "u", V.decision_names(F.col("decision")).alias("decision"))


@query(
    "available_periods",
    Q.flows_sql() + " SELECT period, CAST(count(*) AS BIGINT) AS n, CASE WHEN period IN ('WEEK-2024-01', 'WEEK-2024-02') THEN 'train' WHEN period = 'WEEK-2024-03' THEN 'val' WHEN period = 'WEEK-2024-04' THEN 'test_id' WHEN period = 'WEEK-2024-05' THEN 'test_drift' END AS split FROM fl GROUP BY period",
)
def available_periods(spark: SparkSession, sf: str) -> DataFrame:
    return V.periods_with_split(ev_flows(spark, sf), SP.split_table(spark, SPEC))


@query("stream_throughput")
def stream_throughput(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and batch durations a listener saw while a stream ran."""
    import time

    from flowtide.plans.streams import event_stream
    from flowtide.streaming import run as RUN

    seen = RUN.Throughput()
    spark.streams.addListener(seen)
    try:
        RUN.run_to_table(event_stream(spark, sf).select("event_id"), "throughput")
        for _ in range(50):
            if seen.batch_ms:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(seen)
    c = seen.counters()
    return spark.createDataFrame([(c["batches"], c["rows"], c["p50_ms"], c["p95_ms"])], "batches double, rows double, p50_ms double, p95_ms double")


