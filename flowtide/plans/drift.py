"""Queries over drift monitoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide import bindings as B
from flowtide import schema as S
from flowtide.functions.labels import week_label
from flowtide.operators import budget as U
from flowtide.operators import drift as D
from flowtide.operators import policies as H
from flowtide.operators import scores as C
from flowtide.operators.ordered import global_row_number
from flowtide.plans import sql as Q
from flowtide.plans.budget import STREAM_SQL, stream_parts
from flowtide.plans.inputs import em_scores
from flowtide.plans.policies import reject_theta, safe_sql
from flowtide.plans.registry import query

WINDOW = 20
N = B.EM_CLASSES
DECIDED = f"{Q.theta_sql(0.1)}, {safe_sql(where='TRUE')}"
HIST = ", ".join(f"CAST(count(*) FILTER (prediction = {c}) AS BIGINT)" for c in range(N))
REF_SQL = f"rh AS MATERIALIZED (SELECT [{HIST}] AS ref FROM de WHERE split = 'val')"


def kl_sql(counts: str, ref: str) -> str:
    scale = f"(1.0::DOUBLE + {N} * 0.001::DOUBLE)"
    p = f"(({counts})[c + 1]::DOUBLE / list_sum({counts}) + 0.001::DOUBLE) / {scale}"
    q = f"(({ref})[c + 1]::DOUBLE / list_sum({ref}) + 0.001::DOUBLE) / {scale}"
    return f"CASE WHEN list_sum({counts}) > 0 AND list_sum({ref}) > 0 THEN list_sum(list_transform(range(0, {N}), lambda c: {p} * ln({p} / ({q})))) END"


def signals_sql(group: str, source: str) -> str:
    return f"""(SELECT {group}, CAST(count(*) AS BIGINT) AS n, avg(k) AS mean_k, avg(CASE WHEN decision = 0 THEN 1.0::DOUBLE ELSE 0 END) AS commit_rate,
  avg(CASE WHEN decision IN (1, 3) THEN 1.0::DOUBLE ELSE 0 END) AS reject_rate, avg(p_safe_at) FILTER (decision IN (0, 2)) AS mean_safe_at_commit,
  avg(surprise_at) AS mean_pkt_nll, [{HIST}] AS cnt FROM {source} GROUP BY {group})"""


SIGNALS = ["mean_k", "commit_rate", "reject_rate", "mean_safe_at_commit", "mean_pkt_nll", "prior_kl"]
WINDOWS_SQL = f"""{STREAM_SQL}, {DECIDED}, {REF_SQL},
dw AS MATERIALIZED (SELECT de.*, sm.pos // {WINDOW} AS window_id FROM de JOIN sm ON sm.flow_id = de.flow_id),
ws0 AS MATERIALIZED {signals_sql('window_id', 'dw')},
ws AS MATERIALIZED (SELECT ws0.*, {kl_sql('cnt', 'ref')} AS prior_kl FROM ws0, rh)"""


def em_windows(s: DataFrame) -> DataFrame:
    """Signals of the count windows over validation and test flows in stream order, from score rows."""
    th = reject_theta(s)
    ref = D.reference_histogram(s.where("split = 'val'"), 0.5, th, N)
    stream = U.count_windows(U.stream_order(stream_parts(s)), WINDOW)
    d = H.safe_stop(stream, 0.5, th, keep=[*H.KEEP, "window_id"], extra=["p_safe", "surprise"])
    return D.window_signals(d, ref, N).join(D.dominant_period(d), "window_id")


def rounded(df: DataFrame, cols: list[str], keep: list[str]) -> DataFrame:
    return df.select(*keep, *[F.round(c, 6).alias(c) for c in cols])


ROUND = ", ".join(f"round({s}, 6) AS {s}" for s in SIGNALS)


@query("window_signals", Q.EM_SCORES + f", {WINDOWS_SQL} SELECT CAST(window_id AS BIGINT) AS window_id, n, {ROUND} FROM ws")
def window_signals(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(em_windows(em_scores(spark, sf)), SIGNALS, ["window_id", "n"])


@query(
    "class_histogram",
    Q.EM_SCORES + f", {DECIDED} SELECT period, CAST(c AS INTEGER) AS c, CAST(count(*) FILTER (prediction = c) AS BIGINT) AS n FROM de, range(0, {N}) r(c) WHERE split = 'test' GROUP BY 1, 2",
)
def class_histogram(spark: SparkSession, sf: str) -> DataFrame:
    s = em_scores(spark, sf)
    d = H.safe_stop(s.where("split = 'test'"), 0.5, reject_theta(s))
    return D.class_histogram(d, N, ["period"]).select("period", F.posexplode("counts").alias("c", "n"))


@query(
    "prior_kl",
    Q.EM_SCORES + f", {DECIDED}, {REF_SQL}, pk2 AS (SELECT period, [{HIST}] AS cnt FROM de WHERE split = 'test' GROUP BY period) SELECT period, round({kl_sql('cnt', 'ref')}, 6) AS prior_kl FROM pk2, rh",
)
def prior_kl(spark: SparkSession, sf: str) -> DataFrame:
    s = em_scores(spark, sf)
    th = reject_theta(s)
    ref = D.reference_histogram(s.where("split = 'val'"), 0.5, th, N).select(F.col("counts").alias("ref"))
    per = D.class_histogram(H.safe_stop(s.where("split = 'test'"), 0.5, th), N, ["period"])
    return per.crossJoin(F.broadcast(ref)).select(
        "period", F.round(D.smoothed_kl(F.col("counts"), F.col("ref")), 6).alias("prior_kl")
    )


@query(
    "reference_histogram",
    Q.EM_SCORES + f", {DECIDED}, {REF_SQL} SELECT CAST(c AS INTEGER) AS c, ref[c + 1] AS n FROM rh, range(0, {N}) r(c)",
)
def reference_histogram(spark: SparkSession, sf: str) -> DataFrame:
    s = em_scores(spark, sf)
    return D.reference_histogram(s.where("split = 'val'"), 0.5, reject_theta(s), N).select(F.posexplode("counts").alias("c", "n"))


# --- event series: count windows of 100 events -----------------------------------------------------

EV_SERIES = """ew AS (SELECT (row_number() OVER (ORDER BY ts, event_id) - 1) // 100 AS window_id, value, event_type, ts FROM events),
ser AS MATERIALIZED (SELECT CAST(window_id AS BIGINT) AS window_id, avg(value) AS mean_value, avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0 END) AS error_rate,
  avg(CASE WHEN event_type = 'view' THEN 1.0::DOUBLE ELSE 0 END) AS view_rate, min(ts) AS ts FROM ew GROUP BY window_id),
lng AS MATERIALIZED (SELECT window_id, 'mean_value' AS signal, mean_value AS value FROM ser UNION ALL SELECT window_id, 'error_rate', error_rate FROM ser UNION ALL SELECT window_id, 'view_rate', view_rate FROM ser),
rm AS MATERIALIZED (SELECT signal, avg(value) AS mean, stddev_samp(value) AS std FROM lng WHERE window_id < 8 GROUP BY signal),
zz AS MATERIALIZED (SELECT signal, window_id, round((value - mean) / greatest(std, 1e-9), 9) AS z FROM lng JOIN rm USING (signal))"""
EV_SIGNALS = ["mean_value", "error_rate", "view_rate"]


def cusum_sql(h: str, warm: int, source: str = "zz", key: str = "signal", name: str = "cu") -> str:
    up, dn = "greatest(0.0::DOUBLE, c.pos + z.z - 0.5::DOUBLE)", "greatest(0.0::DOUBLE, c.neg - z.z - 0.5::DOUBLE)"
    al = f"({up} > {h} OR {dn} > {h})"
    keys = ", ".join(f"z.{k}" for k in key.split(", "))
    on = " AND ".join(f"z.{k} = c.{k}" for k in key.split(", "))
    return f"""{name} AS (SELECT {key}, CAST({warm} - 1 AS BIGINT) AS window_id, 0.0::DOUBLE AS pos, 0.0::DOUBLE AS neg, FALSE AS alarm FROM (SELECT DISTINCT {key} FROM {source})
 UNION ALL SELECT {keys}, z.window_id, CASE WHEN {al} THEN 0.0::DOUBLE ELSE {up} END, CASE WHEN {al} THEN 0.0::DOUBLE ELSE {dn} END, {al}
 FROM {name} c JOIN {source} z ON {on} AND z.window_id = c.window_id + 1)"""


def ev_series(spark: SparkSession, sf: str) -> DataFrame:
    events = B.table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    rows = global_row_number(events, ["ts", "event_id"])
    kind = F.col("event_type")
    return rows.groupBy(F.floor((F.col("rn") - 1) / 100).cast("bigint").alias("window_id")).agg(
        F.avg("value").alias("mean_value"),
        F.avg((kind == "error").cast("double")).alias("error_rate"),
        F.avg((kind == "view").cast("double")).alias("view_rate"),
        F.min("ts").alias("ts"),
    )


def ev_z(spark: SparkSession, sf: str) -> DataFrame:
    long = D.unpivot_signals(ev_series(spark, sf), EV_SIGNALS)
    ref = D.reference_moments(ev_series(spark, sf).where("window_id < 8"), EV_SIGNALS)
    return D.standardise(long, ref).withColumn("z", F.round("z", 9))


WITH = "WITH RECURSIVE "


@query("reference_moments", WITH + EV_SERIES + " SELECT signal, round(mean, 6) AS mean, round(std, 6) AS std FROM rm")
def reference_moments(spark: SparkSession, sf: str) -> DataFrame:
    ref = D.reference_moments(ev_series(spark, sf).where("window_id < 8"), EV_SIGNALS)
    return rounded(ref, ["mean", "std"], ["signal"])


@query(
    "cusum_alarms",
    WITH + EV_SERIES + f", {cusum_sql('3.0::DOUBLE', 0)} SELECT signal, window_id, round(pos, 6) AS pos, round(neg, 6) AS neg, alarm FROM cu WHERE window_id >= 0",
)
def cusum_alarms(spark: SparkSession, sf: str) -> DataFrame:
    out = D.cusum(ev_z(spark, sf), 3.0)
    return out.select("signal", "window_id", F.round("pos", 6).alias("pos"), F.round("neg", 6).alias("neg"), "alarm")


@query(
    "cusum_in_blocks",
    WITH + EV_SERIES + f", {cusum_sql('3.0::DOUBLE', 0)} SELECT signal, window_id, round(pos, 6) AS pos, round(neg, 6) AS neg, alarm FROM cu WHERE window_id >= 0",
)
def cusum_in_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The same series handed over in blocks of windows that come in no order."""
    long = ev_z(spark, sf)
    block = F.pmod("window_id", F.lit(3))
    out = D.cusum(C.concat([long.where(block == i) for i in (2, 0, 1)]), 3.0)
    return out.select("signal", "window_id", F.round("pos", 6).alias("pos"), F.round("neg", 6).alias("neg"), "alarm")


LEVELS = """lv AS (SELECT w.window_id, (SELECT count(DISTINCT signal) FROM cu WHERE alarm AND window_id BETWEEN w.window_id - 2 AND w.window_id) AS recent,
  (SELECT coalesce(list_sort(list(signal)), []) FROM cu WHERE alarm AND window_id = w.window_id) AS alarms FROM (SELECT DISTINCT window_id FROM zz) w),
ll AS MATERIALIZED (SELECT window_id, alarms, CASE WHEN recent >= 2 THEN 'alarm' WHEN len(alarms) > 0 THEN 'warning' ELSE 'none' END AS level FROM lv)"""


@query(
    "alarm_levels",
    WITH + EV_SERIES + f", {cusum_sql('3.0::DOUBLE', 5)}, {LEVELS} SELECT window_id, CAST(len(alarms) AS INTEGER) AS n_alarms, level FROM ll",
)
def alarm_levels(spark: SparkSession, sf: str) -> DataFrame:
    folded = D.cusum(ev_z(spark, sf), 3.0, warmup=5)
    return D.alarm_levels(folded).select("window_id", F.size("alarms").alias("n_alarms"), "level")


@query(
    "tune_alarm_threshold",
    WITH + EV_SERIES + f""", hz AS MATERIALIZED (SELECT zz.*, 1.0::DOUBLE + 0.5::DOUBLE * i AS h FROM zz CROSS JOIN range(0, 200) r(i)),
{cusum_sql('z.h', 5, 'hz', 'signal, h')} SELECT min(h) AS h FROM (SELECT h, bool_or(alarm) AS a FROM cu GROUP BY h) WHERE NOT a""",
)
def tune_alarm_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """NULL where the grid has no h without an alarm."""
    return D.quiet_h(ev_z(spark, sf), [1.0 + 0.5 * i for i in range(200)])


@query(
    "first_alarms",
    WITH + EV_SERIES + f""", {cusum_sql('3.0::DOUBLE', 5)}, {LEVELS} SELECT CAST(min(window_id) FILTER (level <> 'none') AS BIGINT) AS first_warning,
 CAST(min(window_id) FILTER (level = 'alarm') AS BIGINT) AS first_alarm, CAST(count(*) FILTER (level = 'alarm') AS BIGINT) AS n_alarm_windows FROM ll""",
)
def first_alarms(spark: SparkSession, sf: str) -> DataFrame:
    levels = D.alarm_levels(D.cusum(ev_z(spark, sf), 3.0, warmup=5))
    return D.first_events(levels).drop("warning_signals")


@query(
    "first_alarm_per_signal",
    WITH + EV_SERIES + f", {cusum_sql('3.0::DOUBLE', 5)} SELECT signal, CAST(min(window_id) FILTER (alarm) AS BIGINT) AS first_alarm FROM cu GROUP BY signal",
)
def first_alarm_per_signal(spark: SparkSession, sf: str) -> DataFrame:
    return D.first_alarm_per_signal(D.cusum(ev_z(spark, sf), 3.0, warmup=5))


# --- weeks -----------------------------------------------------------------------------------------

DOMINANT = "dp AS (SELECT window_id, CAST(arg_max(period, c * 1000 - period) AS INTEGER) AS period FROM (SELECT window_id, period, count(*) AS c FROM dw GROUP BY 1, 2) GROUP BY window_id)"


@query(
    "decided_windows",
    Q.EM_SCORES + f", {WINDOWS_SQL}, {DOMINANT} SELECT CAST(window_id AS BIGINT) AS window_id, period, n, {ROUND} FROM ws JOIN dp USING (window_id)",
)
def decided_windows(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(em_windows(em_scores(spark, sf)), SIGNALS, ["window_id", "period", "n"])


@query(
    "weekly_signal_means",
    Q.EM_SCORES + f", {WINDOWS_SQL}, {DOMINANT} SELECT period, CAST(count(*) AS BIGINT) AS n_windows, {', '.join(f'round(avg({s}), 6) AS {s}' for s in SIGNALS)} FROM ws JOIN dp USING (window_id) GROUP BY period",
)
def weekly_signal_means(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.weekly_means(em_windows(em_scores(spark, sf)), SIGNALS), SIGNALS, ["period", "n_windows"])


def f1_sql(source: str, name: str) -> str:
    """CTE ``name`` (period, f1): macro-F1 over classes with support, per period."""
    return f"""{name}c AS (SELECT period, label, pred, count(*) AS n FROM {source} GROUP BY 1, 2, 3),
{name}l AS (SELECT DISTINCT period, label AS c FROM {name}c),
{name}p AS (SELECT l.period, l.c, coalesce(sum(x.n) FILTER (x.label = l.c AND x.pred = l.c), 0)::DOUBLE AS tp,
  coalesce(sum(x.n) FILTER (x.pred = l.c), 0)::DOUBLE AS pr, coalesce(sum(x.n) FILTER (x.label = l.c AND x.pred IN (SELECT c FROM {name}l q WHERE q.period = l.period)), 0)::DOUBLE AS su
  FROM {name}l l JOIN {name}c x ON x.period = l.period GROUP BY l.period, l.c),
{name} AS MATERIALIZED (SELECT period, avg(CASE WHEN tp = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * (tp/pr) * (tp/su) / (tp/pr + tp/su) END) AS f1 FROM {name}p WHERE su > 0 GROUP BY period)"""


DECAY_SQL = f"""w5 AS (SELECT period, label, pred_raw AS pred FROM su WHERE split = 'test' AND label >= 0 AND k = 5), {f1_sql('w5', 'f5')},
{safe_sql(where="split = 'test' AND label >= 0", th=None, name='dk')}, dkp AS (SELECT period, label, prediction AS pred, k FROM dk), {f1_sql('dkp', 'fp')},
au AS (SELECT period, label < 0 AS y, rank() OVER (PARTITION BY period ORDER BY u) + (count(*) OVER (PARTITION BY period, u) - 1) / 2.0::DOUBLE AS rk FROM su WHERE split = 'test' AND k = 8),
aa AS (SELECT period, CASE WHEN count(*) FILTER (y) > 0 AND count(*) FILTER (NOT y) > 0 THEN (sum(rk) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y) * count(*) FILTER (NOT y)) END AS auc FROM au GROUP BY period),
dec AS MATERIALIZED (SELECT e.period, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (e.label >= 0) AS BIGINT) AS n_known, avg(CASE WHEN e.label < 0 THEN 1.0::DOUBLE ELSE 0 END) AS unknown_share,
  (SELECT avg(CASE WHEN pred = label THEN 1.0::DOUBLE ELSE 0 END) FROM w5 WHERE w5.period = e.period) AS acc_k5, (SELECT f1 FROM f5 WHERE f5.period = e.period) AS macro_f1_k5,
  (SELECT avg(CASE WHEN pred = label THEN 1.0::DOUBLE ELSE 0 END) FROM dkp WHERE dkp.period = e.period) AS policy_accuracy, (SELECT avg(k) FROM dkp WHERE dkp.period = e.period) AS policy_mean_k,
  (SELECT f1 FROM fp WHERE fp.period = e.period) AS policy_macro_f1, (SELECT auc FROM aa WHERE aa.period = e.period) AS unknown_auroc_k8 FROM em e WHERE split = 'test' GROUP BY e.period)"""
DECAY_COLS = ["unknown_share", "acc_k5", "macro_f1_k5", "policy_accuracy", "policy_mean_k", "policy_macro_f1", "unknown_auroc_k8"]


def em_decay(s: DataFrame) -> DataFrame:
    return D.weekly_decay(s.where("split = 'test'"), 0.5, ks=(5,), by=["period"])


@query(
    "weekly_decay",
    Q.EM_SCORES + f", {DECAY_SQL} SELECT period, n, n_known, {', '.join(f'round({c}, 6) AS {c}' for c in DECAY_COLS)} FROM dec",
)
def weekly_decay(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(em_decay(em_scores(spark, sf)), DECAY_COLS, ["period", "n", "n_known"])


@query("weekly_decay_capped")
def weekly_decay_capped(spark: SparkSession, sf: str) -> DataFrame:
    """Every week cut to the same number of flows, so weeks compare like with like."""
    s = em_scores(spark, sf).where("split = 'test'")
    return D.weekly_decay(s, 0.5, ks=(5, 8, 30), by=["period"], week_cap=15)


DECAY_SUMMARY_SQL = f"""WITH wk AS (SELECT {Q.week_sql('o_orderdate')} AS period, CASE WHEN extract('year' FROM o_orderdate) < 1995 THEN 'test_id' ELSE 'test_drift' END AS split, avg(o_totalprice) AS price, CAST(count(*) AS DOUBLE) AS n_orders
  FROM orders GROUP BY 1, 2),
l AS (SELECT split, period, 'price' AS metric, price AS value FROM wk UNION ALL SELECT split, period, 'n_orders', n_orders FROM wk),
r AS (SELECT *, row_number() OVER (PARTITION BY metric, split ORDER BY period) - 1 AS i, count(*) OVER (PARTITION BY metric, split) AS n FROM l),
ds AS (SELECT metric, avg(value) FILTER (split = 'test_id') AS base, avg(value) FILTER (split = 'test_drift' AND i >= n - 4) AS last_drift,
 avg(value) FILTER (split = 'test_drift' AND i >= n - 4) - avg(value) FILTER (split = 'test_id') AS change,
 regr_slope(value, CAST(i AS DOUBLE)) FILTER (split = 'test_drift') AS slope_per_week FROM r GROUP BY metric)"""


def order_decay(spark: SparkSession, sf: str) -> DataFrame:
    orders = B.table(spark, sf, "orders").select("o_orderdate", "o_totalprice")
    split = F.when(F.year("o_orderdate") < 1995, F.lit("test_id")).otherwise(F.lit("test_drift"))
    weeks = orders.groupBy(week_label(F.col("o_orderdate")).alias("period"), split.alias("split")).agg(
        F.avg("o_totalprice").alias("price"), F.count("*").cast("double").alias("n_orders")
    )
    return D.decay_summary(weeks, ["price", "n_orders"])


@query(
    "decay_summary",
    DECAY_SUMMARY_SQL + " SELECT metric, round(base, 4) AS base, round(last_drift, 4) AS last_drift, round(change, 4) AS change, round(slope_per_week, 4) AS slope_per_week FROM ds",
)
def decay_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly order prices and counts of all years, the first three as the base."""
    out = order_decay(spark, sf)
    return out.select("metric", *[F.round(c, 4).alias(c) for c in out.columns if c != "metric"])


@query(
    "decay_early_minus_late",
    DECAY_SUMMARY_SQL + " SELECT round(max(change) FILTER (metric = 'price') - max(change) FILTER (metric = 'n_orders'), 4) AS early_minus_late FROM ds",
)
def decay_early_minus_late(spark: SparkSession, sf: str) -> DataFrame:
    out = D.early_minus_late(order_decay(spark, sf), "price", "n_orders")
    return out.select(F.round("early_minus_late", 4).alias("early_minus_late"))


@query(
    "signal_validation",
    Q.EM_SCORES + f""", {WINDOWS_SQL}, {DOMINANT}, {DECAY_SQL}, wm AS (SELECT period, {', '.join(f'round(avg({s}), 9) AS {s}' for s in SIGNALS)} FROM ws JOIN dp USING (window_id) GROUP BY period),
vl AS ({" UNION ALL ".join(f"SELECT '{s}' AS signal, {s} AS x, policy_macro_f1 AS y FROM wm JOIN dec USING (period)" for s in SIGNALS)}),
rk AS (SELECT signal, rank() OVER (PARTITION BY signal ORDER BY x) + (count(*) OVER (PARTITION BY signal, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY signal ORDER BY y) + (count(*) OVER (PARTITION BY signal, y) - 1) / 2.0::DOUBLE AS ry FROM vl WHERE x IS NOT NULL AND y IS NOT NULL)
SELECT signal, round(corr(rx, ry), 6) AS spearman, CAST(count(*) AS BIGINT) AS n FROM rk GROUP BY signal""",
)
def signal_validation(spark: SparkSession, sf: str) -> DataFrame:
    s = em_scores(spark, sf)
    weekly = D.weekly_means(em_windows(s), SIGNALS)
    cols = [F.round(s, 9).alias(s) for s in SIGNALS]
    out = D.validate_signals(weekly.select("period", *cols), em_decay(s), SIGNALS)
    return out.withColumn("spearman", F.round("spearman", 6))


@query("lead_weeks")
def lead_weeks(spark: SparkSession, sf: str) -> DataFrame:
    s = em_scores(spark, sf)
    windows = em_windows(s)
    ref = D.reference_moments(windows.where("window_id < 5"), SIGNALS)
    _, levels = D.monitor(windows.where("window_id >= 5").withColumn("window_id", F.col("window_id") - 5), ref, SIGNALS, 5.0, warmup=0)
    decay = em_decay(s).withColumn("split", F.when(F.col("period") <= 1, F.lit("test_id")).otherwise(F.lit("test_drift")))
    return D.lead_weeks(decay, windows, levels, "test_id", "test_drift")


@query("monitor_report")
def monitor_report(spark: SparkSession, sf: str) -> DataFrame:
    """Static and controlled mode: signals of every window, their CUSUM and the level."""
    s = em_scores(spark, sf)
    th = reject_theta(s)
    ref_hist = D.reference_histogram(s.where("split = 'val'"), 0.5, th, N)
    stream = U.stream_order(stream_parts(s))
    n_val = s.where("split = 'val'").count() // WINDOW
    loop = U.Loop(6.0, U.Dial(0.5, 0.5, 0.999, 3.0, 0.02), least_flows=10)
    from flowtide.operators import evaluate as V

    thetas = U.replay(stream, {"controller": loop}, bank=V.quantile_bank(s.where("split = 'val'")), window=WINDOW)
    parts = []
    for mode, signals in (("static", S.DRIFT_SIGNALS), ("controller", S.CONTROLLED_SIGNALS)):
        rows = U.count_windows(stream, WINDOW, drop_ragged=True)
        if mode == "controller":
            rows = rows.join(F.broadcast(thetas.select("window_id", F.col("theta").alias("theta_commit"))), "window_id")
        else:
            rows = rows.withColumn("theta_commit", F.lit(0.5))
        d = H.safe_stop(rows, F.col("theta_commit"), th, keep=[*H.KEEP, "window_id", "theta_commit"], extra=["p_safe", "surprise"])
        windows = D.window_signals(d, ref_hist, N, theta="theta_commit")
        ref = D.reference_moments(windows.where(F.col("window_id") < n_val), signals)
        test = windows.where(F.col("window_id") >= n_val).withColumn("window_id", F.col("window_id") - n_val)
        per, levels = D.monitor(test, ref, signals, 5.0, warmup=1)
        parts.append(per.join(levels.select("window_id", "level"), "window_id").withColumn("mode", F.lit(mode)))
    return C.concat(parts)
