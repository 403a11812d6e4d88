"""Watching a stream of decisions without labels: window signals, CUSUM alarms, weekly decay."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from flowtide import schema as S
from flowtide.functions.draws import uniform
from flowtide.operators import metrics as M
from flowtide.operators import policies as H
from flowtide.operators import scores as C
from flowtide.operators.budget import count_windows, stream_order

KL_SMOOTHING = 1e-3
STD_FLOOR = 1e-9


def class_histogram(decisions: DataFrame, n_classes: int, by: Sequence[str] = ()) -> DataFrame:
    """(…, counts): committed classes, zero-filled to ``n_classes``; one row per group."""
    p = F.col("prediction")
    return decisions.groupBy(*by).agg(
        F.array(*[F.sum((p == c).cast("bigint")) for c in range(n_classes)]).alias("counts")
    )


def smoothed_kl(counts: Column, reference: Column, smoothing: float = KL_SMOOTHING) -> Column:
    """KL of two histograms, ``smoothing`` added to every frequency; NULL if either is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    n = F.size(counts)
    scale = F.lit(1.0) + n * smoothing
    freq = lambda a, t: F.transform(a, lambda v: (v / t + smoothing) / scale)
    p = freq(counts, total(counts))
    q = freq(reference, total(reference))
    kl = F.aggregate(F.zip_with(p, q, lambda a, b: a * F.log(a / b)), F.lit(0.0), lambda s, v: s + v)
    return F.when((total(counts) > 0) & (total(reference) > 0), kl)


def window_signals(
    decisions: DataFrame, reference: DataFrame, n_classes: int, by: Sequence[str] = ("window_id",), theta: str | None = None
) -> DataFrame:
    """The signals of every window, one aggregate.

    Needs ``p_safe_at`` and ``surprise_at``; ``reference`` is one row (``counts``).
    """
    d = F.col("decision")
    committed = d.isin(S.COMMIT, S.FORCED_COMMIT)
    p = F.col("prediction")
    aggs = [
        F.count("*").alias("n"),
        F.avg("k").alias("mean_k"),
        F.avg((d == S.COMMIT).cast("double")).alias("commit_rate"),
        F.avg(d.isin(S.REJECT, S.FORCED_REJECT).cast("double")).alias("reject_rate"),
        F.avg(F.when(committed, F.col("p_safe_at"))).alias("mean_safe_at_commit"),
        F.avg("surprise_at").alias("mean_pkt_nll"),
        F.array(*[F.sum((p == c).cast("bigint")) for c in range(n_classes)]).alias("_counts"),
    ]
    if theta:
        aggs.append(F.max(theta).alias("theta_commit"))
    rows = decisions.groupBy(*by).agg(*aggs)
    ref = reference.select(F.col("counts").alias("_ref"))
    return (
        rows.crossJoin(F.broadcast(ref))
        .withColumn("prior_kl", smoothed_kl(F.col("_counts"), F.col("_ref")))
        .drop("_counts", "_ref")
    )


def dominant_period(decisions: DataFrame, by: Sequence[str] = ("window_id",)) -> DataFrame:
    """Most common period of every window; the lowest wins a tie."""
    counts = decisions.groupBy(*by, "period").agg(F.count("*").alias("_c"))
    return counts.groupBy(*by).agg(F.min_by("period", F.struct(-F.col("_c"), F.col("period"))).alias("period"))


def unpivot_signals(windows: DataFrame, signals: Sequence[str], keep: Sequence[str] = ("window_id",)) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("value")) for s in signals])
    return windows.select(*keep, F.explode(pairs).alias("e")).select(*keep, "e.signal", "e.value")


def reference_moments(windows: DataFrame, signals: Sequence[str]) -> DataFrame:
    """(signal, mean, std) over validation windows; fewer than two usable windows raise."""
    long = unpivot_signals(windows, signals).where("value is not null and not isnan(value)")
    stats = long.groupBy("signal").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("*").alias("n"))
    names = windows.sparkSession.createDataFrame([(s,) for s in signals], "signal string")
    full = names.join(stats, "signal", "left")
    return full.select(
        "signal",
        F.when(
            F.coalesce("n", F.lit(0)) < 2,
            F.raise_error(F.concat(F.lit("need at least two windows with "), F.col("signal"))).cast("double"),
        ).otherwise(F.col("mean")).alias("mean"),
        "std",
    )


def standardise(long: DataFrame, reference: DataFrame) -> DataFrame:
    """Adds ``z``; the reference has one row per signal."""
    z = (F.col("value") - F.col("mean")) / F.greatest("std", F.lit(STD_FLOOR))
    return long.join(F.broadcast(reference), "signal").withColumn("z", z).drop("mean", "std")


def cusum(long: DataFrame, h: float | Column = 5.0, k: float = 0.5, warmup: int = 0, by: Sequence[str] = ("signal",)) -> DataFrame:
    """Two-sided CUSUM with reset per series: adds pos, neg, alarm.

    Windows before ``warmup`` are not accumulated, values that are no finite number are passed over. A series is read
    in order as a stream that holds two sums; series are dealt over the tasks, and a task does not hold its rows.
    """
    by = list(by)
    limit = h if isinstance(h, Column) else F.lit(float(h))
    rows = long.select(*by, "window_id", "z", limit.cast("double").alias("_h"))
    names = [*by, "window_id", "z"]
    schema = T.StructType([*(rows.schema[n] for n in names), *(T.StructField(n, T.DoubleType()) for n in ("pos", "neg")), T.StructField("alarm", T.BooleanType())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, up, down = None, 0.0, 0.0
        for b in batches:
            series = list(zip(*(b.column(c).to_pylist() for c in by), strict=True))
            out = []
            for s, w, z, top in zip(series, *(b.column(c).to_pylist() for c in ("window_id", "z", "_h")), strict=True):
                if s != here:
                    here, up, down = s, 0.0, 0.0
                alarm = False
                if z is not None and math.isfinite(z) and w >= warmup:
                    up, down = max(0.0, up + z - k), max(0.0, down - z - k)
                    if alarm := up > top or down > top:
                        up = down = 0.0
                out.append((up, down, alarm))
            made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.float64(), pa.float64(), pa.bool_()), strict=True)] if out else [pa.array([], t) for t in (pa.float64(), pa.float64(), pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *made], names=[*names, "pos", "neg", "alarm"])

    return rows.repartition(*by).sortWithinPartitions(*by, "window_id").mapInArrow(stream, schema)


def alarm_levels(alarms: DataFrame, span: int = 3) -> DataFrame:
    """(window_id, alarms, level): warning on any alarm, alarm when at least two distinct signals
    alarmed within the last ``span`` windows.

    A window only looks at ``span`` windows, so an alarm is sent to the windows it can reach
    instead of ordering all windows in one place.
    """
    reach = F.explode(F.sequence(F.col("window_id"), F.col("window_id") + span - 1)).alias("_w")
    seen = alarms.where("alarm").select("signal", "window_id", reach)
    per = seen.groupBy(F.col("_w").alias("window_id")).agg(
        F.array_sort(F.collect_set("signal")).alias("recent"),
        F.array_sort(F.collect_set(F.when(F.col("window_id") == F.col("_w"), F.col("signal")))).alias("alarms"),
    )
    windows = alarms.select("window_id").distinct()
    none = F.array().cast("array<string>")
    rows = windows.join(per, "window_id", "left").withColumns(
        {"recent": F.coalesce("recent", none), "alarms": F.coalesce("alarms", none)}
    )
    level = F.when(F.size("recent") >= 2, F.lit("alarm")).when(F.size("alarms") > 0, F.lit("warning")).otherwise(F.lit("none"))
    return rows.select("window_id", "alarms", level.alias("level"))


def h_grid(start: float = 5.0, step: float = 0.5, top: float = 30.0) -> list[float]:
    return [start + step * i for i in range(int((top - start) / step + 1e-9) + 1)]


def quiet_h(long: DataFrame, grid: Sequence[float], k: float = 0.5, warmup: int = 5) -> DataFrame:
    """(h): the smallest h of the grid without an alarm on any series, NULL when even the last one alarms."""
    wide = long.select("*", F.explode(F.array(*[F.lit(float(h)) for h in grid])).alias("h"))
    folded = cusum(wide, F.col("h"), k, warmup, ["signal", "h"])
    return folded.groupBy("h").agg(F.max(F.col("alarm").cast("int")).alias("a")).where("a = 0").agg(F.min("h").alias("h"))


def tune_h(long: DataFrame, k: float = 0.5, warmup: int = 5, grid: Sequence[float] | None = None) -> float:
    """Smallest h without an alarm on any validation series; raises when even the last one alarms."""
    hs = list(grid or h_grid())
    best = quiet_h(long, hs, k, warmup).first()["h"]
    if best is None:
        raise ValueError(f"validation still alarms at h = {hs[-1]}")
    return float(best)


def monitor(windows: DataFrame, reference: DataFrame, signals: Sequence[str], h: float, k: float = 0.5, warmup: int = 5, span: int = 3) -> tuple[DataFrame, DataFrame]:
    """(per signal and window: z, sums, alarm; per window: alarms, level)."""
    long = standardise(unpivot_signals(windows, signals), reference)
    folded = cusum(long, h, k, warmup)
    rows = long.join(folded.drop("z"), ["signal", "window_id"])
    return rows, alarm_levels(folded, span)


def decided_windows(
    scores: DataFrame, window: int, theta: float, theta_reject: Sequence[float | None], reference: DataFrame, n_classes: int,
) -> DataFrame:
    """Decide every flow in time order and return each window's signals and dominant period."""
    ordered = count_windows(stream_order([("all", scores)]), window, drop_ragged=True)
    d = H.safe_stop(ordered, theta, theta_reject, keep=[*H.KEEP, "window_id"], extra=["p_safe", "surprise"])
    return window_signals(d, reference, n_classes).join(dominant_period(d), "window_id")


def reference_histogram(val: DataFrame, theta: float, theta_reject: Sequence[float | None], n_classes: int) -> DataFrame:
    return class_histogram(H.safe_stop(val, theta, theta_reject), n_classes)


# --- weeks -----------------------------------------------------------------------------------------


def weekly_means(windows: DataFrame, signals: Sequence[str], by: Sequence[str] = ("period",)) -> DataFrame:
    """Mean of every signal over the windows of a week (missing values skipped)."""
    ok = lambda s: F.when(F.col(s).isNotNull() & ~F.isnan(F.col(s).cast("double")), F.col(s))
    return windows.groupBy(*by).agg(F.count("*").alias("n_windows"), *[F.avg(ok(s)).alias(s) for s in signals])


def cap_per_week(scores: DataFrame, cap: int, seed: int, by: str = "period") -> DataFrame:
    """Exactly ``min(cap, n)`` rows per week, drawn by a hash of (seed, week, row).

    A row number below a limit is cut in every task before the shuffle, so a week sends at most
    ``cap`` rows per task.
    """
    w = W.partitionBy(by).orderBy(uniform(seed, "week-cap", F.col(by), F.col("flow_id")), "flow_id")
    return scores.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")


def weekly_decay(
    scores: DataFrame, theta: float, ks: Sequence[int] = (5, 8, 30), auroc_k: int = 8, by: Sequence[str] = ("split", "period"),
    week_cap: int | None = None, seed: int = 0,
) -> DataFrame:
    """One row per week: accuracy and macro-F1 at fixed K and of the policy, unknown AUROC, share."""
    by = list(by)
    if week_cap is not None:
        scores = cap_per_week(scores, week_cap, seed)
    known = C.known_only(scores)
    out = scores.groupBy(*by).agg(
        F.count("*").alias("n"), F.count(F.when(F.col("label") >= 0, 1)).alias("n_known"),
        F.avg((F.col("label") < 0).cast("double")).alias("unknown_share"),
    )
    for k in ks:
        rows = known.select(*by, "label", F.element_at("pred_raw", F.least(F.lit(k), "ppi_len", F.lit(S.K_MAX)).cast("int")).alias("pred"))
        acc = M.accuracy(rows, by).withColumnRenamed("accuracy", f"acc_k{k}")
        f1 = M.macro_scores(rows, by=by).select(*by, F.col("macro_f1").alias(f"macro_f1_k{k}"))
        out = out.join(acc, by, "left").join(f1, by, "left")
    d = H.safe_stop(known.drop("u"), theta, keep=["label", *by]).withColumnRenamed("prediction", "pred")
    pol = d.groupBy(*by).agg(F.avg(M.is_correct()).alias("policy_accuracy"), F.avg("k").alias("policy_mean_k"))
    f1 = M.macro_scores(d, by=by).select(*by, F.col("macro_f1").alias("policy_macro_f1"))
    out = out.join(pol, by, "left").join(f1, by, "left")
    if "u" in scores.columns:
        u = scores.select(*by, "label", F.element_at("u", auroc_k).alias("value"))
        a = M.auroc(u, "value", F.col("label") < 0, by).select(*by, F.col("auroc").alias(f"unknown_auroc_k{auroc_k}"))
        out = out.join(a, by, "left")
    return out


def decay_summary(weeks: DataFrame, metrics: Sequence[str], base: str = "test_id", drift: str = "test_drift", last: int = 4) -> DataFrame:
    """Per metric: mean over base weeks, mean over the last drift weeks, change, slope per week."""
    long = weeks.select("split", "period", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("e"))
    long = long.select("split", "period", "e.metric", "e.value").where("value is not null")
    w = W.partitionBy("metric", "split").orderBy("period")
    rows = long.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(W.partitionBy("metric", "split")))
    is_drift = F.col("split") == drift
    b = F.avg(F.when(F.col("split") == base, F.col("value")))
    tail = F.avg(F.when(is_drift & (F.col("_i") >= F.col("_n") - last), F.col("value")))
    slope = F.regr_slope(F.when(is_drift, F.col("value")), F.when(is_drift, F.col("_i").cast("double")))
    return rows.groupBy("metric").agg(
        b.alias("base"), tail.alias("last_drift"), (tail - b).alias("change"), slope.alias("slope_per_week")
    )


def early_minus_late(summary: DataFrame, early: str, late: str) -> DataFrame:
    """How much more an early prefix changed than a late one: the difference of two metrics' changes, below zero
    when the early one loses more."""
    change = lambda m: F.max(F.when(F.col("metric") == m, F.col("change")))
    return summary.agg((change(early) - change(late)).alias("early_minus_late"))


def first_events(levels: DataFrame) -> DataFrame:
    """First warning, first alarm and number of alarm windows."""
    warn = F.col("level") != "none"
    alarm = F.col("level") == "alarm"
    return levels.agg(
        F.min(F.when(warn, F.col("window_id"))).alias("first_warning"),
        F.min(F.when(alarm, F.col("window_id"))).alias("first_alarm"),
        F.count(F.when(alarm, 1)).alias("n_alarm_windows"),
        F.min_by("alarms", F.when(warn, F.col("window_id"))).alias("warning_signals"),
    )


def first_alarm_per_signal(rows: DataFrame) -> DataFrame:
    return rows.groupBy("signal").agg(F.min(F.when(F.col("alarm"), F.col("window_id"))).alias("first_alarm"))


def validate_signals(weekly: DataFrame, decay: DataFrame, signals: Sequence[str], target: str = "policy_macro_f1") -> DataFrame:
    """Rank correlation of every weekly signal with the weekly metric."""
    both = weekly.join(decay.select("period", F.col(target).alias("_y")), "period")
    long = both.select("_y", F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("value")) for s in signals])).alias("e"))
    return M.spearman(long.select("_y", "e.signal", "e.value"), "value", "_y", ["signal"])


def lead_weeks(
    decay: DataFrame, windows: DataFrame, levels: DataFrame, base_split: str, drift_split: str, metric: str = "policy_macro_f1",
    drop: float = 0.03,
) -> DataFrame:
    """Floor = base mean minus the drop; first drift week at or below it; weeks the warning and the
    alarm came earlier (positive = before)."""
    # weeks are counted by their place among the weeks on record, so labels may be of any type
    weeks = decay.withColumn("_at", F.row_number().over(W.orderBy(F.col("split") == drift_split, "period")))
    floor = weeks.agg((F.avg(F.when(F.col("split") == base_split, F.col(metric))) - drop).alias("floor"))
    low = F.when((F.col("split") == drift_split) & (F.col(metric) <= F.col("floor")), F.col("_at"))
    below = weeks.crossJoin(F.broadcast(floor)).agg(
        F.max("floor").alias("floor"), F.min_by("period", low).alias("first_below"), F.min(low).alias("_below")
    )
    hits = windows.select("window_id", "period").join(levels, "window_id").agg(
        F.min_by("period", F.when(F.col("level") != "none", F.col("window_id"))).alias("warning_week"),
        F.min_by("period", F.when(F.col("level") == "alarm", F.col("window_id"))).alias("alarm_week"),
    )
    one = below.crossJoin(hits)
    for name in ("warning", "alarm"):
        at = weeks.groupBy(F.col("period").alias(f"{name}_week")).agg(F.max("_at").alias("_hit"))
        one = one.join(F.broadcast(at), f"{name}_week", "left").withColumn(f"lead_{name}", F.col("_below") - F.col("_hit")).drop("_hit")
    return one.select("floor", "first_below", "warning_week", "alarm_week", "lead_warning", "lead_alarm")
