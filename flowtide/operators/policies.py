"""Early decisions over score rows: commit to a class, reject as unknown, or keep reading.

A policy is a narrow projection of a score row (its arrays hold all 30 prefixes), so deciding
shuffles nothing. Sweeps do not replay a policy per threshold: the first K whose score reaches a
threshold only changes at record highs, so every flow sends at most one row per record high.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from flowtide import schema as S
from flowtide.operators.ordered import running_totals
from flowtide.operators.scores import known_only
from flowtide.session import cut

NEVER: list[float | None] = [None] * S.K_MAX
ORDERS = ("reject_first", "commit_first")


def _check_order(order: str) -> None:
    if order not in ORDERS:
        raise ValueError(f"order must be one of {ORDERS}, got {order!r}")


def last_k(k_cap: Column | int = S.K_MAX) -> Column:
    cap = F.lit(k_cap) if isinstance(k_cap, int) else k_cap
    return F.least("ppi_len", cap).cast("int")


def theta_column(theta: Sequence[float | None]) -> Column:
    return F.array(*[F.lit(t).cast("double") for t in theta])


def _first(mask: Column) -> Column:
    """1-based position of the first true; 31 where none."""
    at = F.array_position(mask, True)
    return F.when(at == 0, F.lit(S.K_MAX + 1)).otherwise(at).cast("int")


def _num(p: Column) -> Column:
    """Score with missing and NaN as 0."""
    return F.when(p.isNull() | F.isnan(p), F.lit(0.0)).otherwise(p)


def _unk(u: Column) -> Column:
    """Unknown score with missing and NaN as +infinity."""
    return F.when(u.isNull() | F.isnan(u), F.lit(float("inf"))).otherwise(u)


def decide(
    k: Column, p: Column, u: Column, pred: Column, theta_commit: Column, theta_reject: Column, last: Column,
    k_min: int = 2, k_ood: int = 3, order: str = "reject_first",
) -> Column:
    """The rule after ``k`` packets: a struct (decision, prediction), NULL to keep reading.

    The one definition of the rule; the batch form and the stream both agree with it.
    """
    _check_order(order)
    bad = (k < 1) | (k > last)
    rejects = F.coalesce(_unk(u) >= theta_reject, F.lit(False))
    reject_now = (k >= k_ood) & rejects
    commit_now = (k >= k_min) & (_num(p) >= theta_commit)

    def made(code: int) -> Column:
        cls = F.lit(S.UNKNOWN) if code in (S.REJECT, S.FORCED_REJECT) else pred.cast("int")
        return F.struct(F.lit(code).alias("decision"), cls.alias("prediction"))

    first, second = (reject_now, S.REJECT), (commit_now, S.COMMIT)
    if order == "commit_first":
        first, second = second, first
    out = F.when(bad, F.raise_error(F.lit("k outside 1..last")).cast("struct<decision:int,prediction:int>"))
    out = out.when(first[0], made(first[1])).when(second[0], made(second[1]))
    out = out.when((k == last) & rejects, made(S.FORCED_REJECT)).when(k == last, made(S.FORCED_COMMIT))
    return out


def _picked(scores: DataFrame, keep: Sequence[str], extra: Sequence[str]) -> list[Column]:
    at = lambda c: F.element_at(c, F.col("k"))
    return [F.col(c) for c in keep] + [at(c).alias(f"{c}_at") for c in extra]


KEEP = ("flow_id", "label", "period", "ppi_len")


def safe_stop(
    scores: DataFrame,
    theta_commit: float | Column,
    theta_reject: Sequence[float | None] | Column = tuple(NEVER),
    *,
    k_min: int = 2,
    k_ood: int = 3,
    order: str = "reject_first",
    k_cap: int | Column = S.K_MAX,
    keep: Sequence[str] = KEEP,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Decision of every flow: the first K that rejects or commits, else forced at the last K.

    ``n_nan`` counts the scores of a flow that were missing where the rule looked.
    """
    _check_order(order)
    last = last_k(k_cap)
    th = theta_reject if isinstance(theta_reject, Column) else theta_column(theta_reject)
    theta = F.lit(float(theta_commit)) if not isinstance(theta_commit, Column) else theta_commit
    has_u = "u" in scores.columns
    u = F.col("u") if has_u else F.array_repeat(F.lit(0.0), S.K_MAX)
    seen = scores.withColumns({"_last": last, "_th": th, "_theta": theta, "_u": u})
    rejects = F.transform(
        "_u",
        lambda v, i: F.coalesce(_unk(v) >= F.element_at("_th", i + 1), F.lit(False))
        & (i + 1 >= k_ood) & (i + 1 <= F.col("_last")),
    )
    commits = F.transform(
        "p_safe", lambda v, i: (_num(v) >= F.col("_theta")) & (i + 1 >= k_min) & (i + 1 <= F.col("_last"))
    )
    seen = seen.withColumns({"_kr": _first(rejects), "_kc": _first(commits)})
    early = F.least("_kr", "_kc")
    wins = F.col("_kr") <= F.col("_kc") if order == "reject_first" else F.col("_kr") < F.col("_kc")
    forced = F.coalesce(
        _unk(F.element_at("_u", F.col("_last"))) >= F.element_at("_th", F.col("_last")), F.lit(False)
    )
    decision = F.when(
        early <= S.K_MAX, F.when(wins, F.lit(S.REJECT)).otherwise(F.lit(S.COMMIT))
    ).otherwise(F.when(forced, F.lit(S.FORCED_REJECT)).otherwise(F.lit(S.FORCED_COMMIT)))
    missing = lambda a: F.exists(
        F.slice(a, F.lit(1), F.col("_last")), lambda v: v.isNull() | F.isnan(v)
    ).cast("int")
    seen = seen.withColumns(
        {
            "k": F.when(early <= S.K_MAX, early).otherwise(F.col("_last")),
            "decision": decision,
            "n_nan": missing(F.col("p_safe")) + missing(F.col("_u")),
        }
    )
    rejected = F.col("decision").isin(S.REJECT, S.FORCED_REJECT)
    return seen.select(
        *_picked(scores, keep, extra), "k", "decision",
        F.when(rejected, F.lit(S.UNKNOWN)).otherwise(F.element_at("pred", F.col("k"))).cast("int").alias("prediction"),
        "n_nan",
    )


#: where a flow that no rule stopped is decided: at its own last packet, or at the end of the grid
FORCED_AT = ("flow_end", "grid_end")


def _forced_k(force_at: str, flow: Column, grid: Column) -> Column:
    if force_at not in FORCED_AT:
        raise ValueError(f"a decision is forced at one of {', '.join(FORCED_AT)}")
    return grid if force_at == FORCED_AT[1] else flow


def confidence_stop(
    scores: DataFrame, tau: float | Column, *, k_cap: int = S.K_MAX, force_at: str = "flow_end",
    keep: Sequence[str] = KEEP,
) -> DataFrame:
    """Commit at the first K whose confidence is at least ``tau``."""
    t = F.lit(float(tau)) if not isinstance(tau, Column) else tau
    seen = scores.withColumns({"_last": last_k(k_cap), "_t": t})
    hit = F.transform("conf", lambda v, i: (v >= F.col("_t")) & (i + 1 <= F.col("_last")))
    seen = seen.withColumn("_kh", _first(hit))
    early = F.col("_kh") <= S.K_MAX
    forced = _forced_k(force_at, F.col("_last"), F.lit(k_cap))
    seen = seen.withColumn("k", F.when(early, F.col("_kh")).otherwise(forced))
    return seen.select(
        *keep, "k",
        F.when(early, F.lit(S.COMMIT)).otherwise(F.lit(S.FORCED_COMMIT)).alias("decision"),
        F.element_at("pred", F.least("k", "_last")).alias("prediction"),
    )


def class_threshold_stop(
    scores: DataFrame, tau: Sequence[float] | Column, theta: float | None, *, energy_k: int = 10,
    k_cap: int = S.K_MAX, force_at: str = "flow_end", keep: Sequence[str] = KEEP,
) -> DataFrame:
    """Commit when the predicted class's own threshold is cleared; a flow not committed by
    ``energy_k`` is rejected if its raw energy there is at least ``theta``."""
    t = tau if isinstance(tau, Column) else F.array(*[F.lit(float(x)) for x in tau])
    seen = scores.withColumns({"_last": last_k(k_cap), "_tau": t})
    hit = F.transform(
        F.arrays_zip("conf", "pred"),
        lambda v, i: (v["conf"] >= F.element_at("_tau", v["pred"] + 1)) & (i + 1 <= F.col("_last")),
    )
    seen = seen.withColumns({"_kh": _first(hit), "_gate": F.least(F.lit(energy_k), F.col("_last")).cast("int")})
    gated = (
        F.lit(False)
        if theta is None
        else (F.col("_kh") > F.col("_gate")) & (F.element_at("energy_raw", F.col("_gate")) >= F.lit(float(theta)))
    )
    gate_k = _forced_k(force_at, F.col("_gate"), F.lit(energy_k))
    forced = _forced_k(force_at, F.col("_last"), F.lit(k_cap))
    early = F.col("_kh") <= S.K_MAX
    seen = seen.withColumns(
        {
            "k": F.when(gated, gate_k).when(early, F.col("_kh")).otherwise(forced),
            "decision": F.when(gated, F.lit(S.REJECT)).when(early, F.lit(S.COMMIT)).otherwise(F.lit(S.FORCED_COMMIT)),
        }
    )
    return seen.select(
        *keep, "k", "decision",
        F.when(F.col("decision") == S.REJECT, F.lit(S.UNKNOWN))
        .otherwise(F.element_at("pred", F.least("k", "_last"))).cast("int").alias("prediction"),
    )


# --- thresholds from validation -------------------------------------------------------------------


def precision_thresholds(
    rows: DataFrame, precisions: Sequence[float], by: Sequence[str] = (), row_id: str = "flow_id"
) -> DataFrame:
    """(…, precision, tau): lowest confidence whose descending prefix keeps the precision; 1 if none.

    ``rows`` has ``conf`` and ``correct`` (0/1).
    """
    r = running_totals(
        rows, by, [F.col("conf").desc(), F.col(row_id)],
        {"_rn": F.lit(1).cast("bigint"), "_hit": F.col("correct").cast("bigint")},
    )
    wide = r.select(
        *by, "conf", "_rn", (F.col("_hit") / F.col("_rn")).alias("_p"),
        F.explode(F.array(*[F.lit(float(p)) for p in precisions])).alias("precision"),
    )
    return wide.groupBy(*by, "precision").agg(
        F.coalesce(
            F.max_by("conf", F.when(F.col("_p") >= F.col("precision"), F.col("_rn"))), F.lit(1.0)
        ).alias("tau"),
        F.max("_rn").alias("support"),
    )


def last_prefix(scores: DataFrame) -> DataFrame:
    """Confidence, prediction and correctness at every flow's last prefix."""
    at = lambda c: F.element_at(c, last_k())
    return known_only(scores).select(
        "flow_id", "label", at("conf").alias("conf"), at("pred").alias("pred"),
        (at("pred") == F.col("label")).cast("int").alias("correct"),
    )


def class_thresholds(
    val: DataFrame, precisions: Sequence[float], n_classes: int, min_support: int = 20
) -> DataFrame:
    """(precision, taus): one threshold per class; a class with little support takes the global one."""
    rows = last_prefix(val)
    own = precision_thresholds(rows, precisions, ["pred"]).where(F.col("support") >= min_support)
    everyone = precision_thresholds(rows, precisions).select("precision", F.col("tau").alias("_global"))
    per = own.groupBy("precision").agg(
        F.map_from_entries(F.collect_list(F.struct("pred", "tau"))).alias("_own")
    )
    classes = F.sequence(F.lit(0), F.lit(n_classes - 1))
    return everyone.join(per, "precision", "left").select(
        "precision",
        F.transform(
            classes, lambda c: F.coalesce(F.element_at(F.col("_own"), c), F.col("_global"))
        ).alias("taus"),
    )


# --- sweeps ---------------------------------------------------------------------------------------


def logit(p: float) -> float:
    return math.log(p / (1.0 - p))


def sigmoid(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-x))


def logit_grid(n: int = 200, lo: float = 0.5, hi: float = 0.999) -> list[float]:
    """``n`` thresholds, evenly spread in log odds."""
    return [sigmoid(float(x)) for x in np.linspace(logit(lo), logit(hi), n)]


def record_segments(
    scores: DataFrame, value: str, *, k_min: int = 1, theta_reject: Sequence[float | None] = tuple(NEVER),
    k_ood: int = 3, order: str = "reject_first", k_cap: int = S.K_MAX, keep: Sequence[str] = ("flow_id", "label"),
) -> DataFrame:
    """Outcome of a threshold rule for every threshold at once.

    Rows (keep, above, upto, k, k_before, decision, prediction): for thresholds in (above, upto] the
    flow stops at ``k``; ``k_before`` is the stop of the segment below (NULL in the first). At most one row per record high plus the forced one. ``above`` is NULL for
    minus infinity, ``upto`` NULL for plus infinity.
    """
    _check_order(order)
    never = all(t is None for t in theta_reject)
    base = scores.withColumns({"_last": last_k(k_cap)})
    if never:
        base = base.withColumns({"_kr": F.lit(S.K_MAX + 1), "_forced_reject": F.lit(False)})
    else:
        base = base.withColumn("_th", theta_column(theta_reject))
        rejects = F.transform(
            "u",
            lambda v, i: F.coalesce(_unk(v) >= F.element_at("_th", i + 1), F.lit(False))
            & (i + 1 >= k_ood) & (i + 1 <= F.col("_last")),
        )
        base = base.withColumns(
            {
                "_kr": _first(rejects),
                "_forced_reject": F.coalesce(
                    _unk(F.element_at("u", F.col("_last"))) >= F.element_at("_th", F.col("_last")), F.lit(False)
                ),
            }
        )
    # commits can win up to here: before the rejection, or at it when commits are looked at first
    stop = F.when(F.col("_kr") > S.K_MAX, F.col("_last")).otherwise(
        F.col("_kr") - (1 if order == "reject_first" else 0)
    )
    base = base.withColumn("_upto_k", F.least(stop, F.col("_last")))
    start = F.struct(F.lit(0).alias("k"), F.lit(None).cast("double").alias("best"), F.lit(None).cast("int").alias("at"),
                     F.array().cast("array<struct<above:double,upto:double,k:int,k_before:int>>").alias("out"))

    def step(acc: Column, v: Column) -> Column:
        k = acc["k"] + 1
        value = _num(v)
        record = (k >= k_min) & (k <= F.col("_upto_k")) & (acc["best"].isNull() | (value > acc["best"]))
        seg = F.struct(acc["best"].alias("above"), value.alias("upto"), k.alias("k"), acc["at"].alias("k_before"))
        return F.struct(
            k.alias("k"),
            F.when(record, value).otherwise(acc["best"]).alias("best"),
            F.when(record, k).otherwise(acc["at"]).alias("at"),
            F.when(record, F.concat(acc["out"], F.array(seg))).otherwise(acc["out"]).alias("out"),
        )

    base = base.withColumn("_r", F.aggregate(value, start, step))
    end_k = F.when(F.col("_kr") <= S.K_MAX, F.col("_kr")).otherwise(F.col("_last"))
    tail = F.array(F.struct(F.col("_r.best").alias("above"), F.lit(None).cast("double").alias("upto"), F.lit(0).alias("k"),
                            F.col("_r.at").alias("k_before")))
    segs = base.select(
        *keep, "pred", "_kr", "_forced_reject", end_k.alias("_end"), F.explode(F.concat("_r.out", tail)).alias("s")
    )
    final = F.col("s.upto").isNull()
    code = F.when(~final, F.lit(S.COMMIT)).when(F.col("_kr") <= S.K_MAX, F.lit(S.REJECT)).when(
        F.col("_forced_reject"), F.lit(S.FORCED_REJECT)
    ).otherwise(F.lit(S.FORCED_COMMIT))
    k = F.when(final, F.col("_end")).otherwise(F.col("s.k"))
    out = segs.select(*keep, F.col("s.above").alias("above"), F.col("s.upto").alias("upto"), k.alias("k"),
                      F.col("s.k_before").alias("k_before"), code.alias("decision"), "pred")
    gone = F.col("decision").isin(S.REJECT, S.FORCED_REJECT)
    return out.select(
        *keep, "above", "upto", "k", "k_before", "decision",
        F.when(gone, F.lit(S.UNKNOWN)).otherwise(F.element_at("pred", F.col("k"))).alias("prediction"),
    )


def sweep_histogram(segments: DataFrame, grid: Sequence[float]) -> DataFrame:
    """(theta, k, decision, known, correct, n): decision counts at every threshold of a grid.

    A segment adds its flow at the first threshold it covers and takes it away after the last, so
    rows are summed to a few counts per threshold before anything is expanded.
    """
    thetas = sorted(float(t) for t in grid)
    arr = F.array(*[F.lit(t) for t in thetas])
    below = lambda x: F.size(F.filter(arr, lambda t: t <= x))
    lo = F.when(F.col("above").isNull(), F.lit(0)).otherwise(below(F.col("above")))
    hi = F.when(F.col("upto").isNull(), F.lit(len(thetas))).otherwise(below(F.col("upto")))
    key = ["k", "decision", "known", "correct"]
    marks = (
        segments.select(
            "k", "decision", (F.col("label") >= 0).alias("known"),
            (F.col("prediction") == F.col("label")).alias("correct"), lo.alias("lo"), hi.alias("hi"),
        )
        .where("hi > lo")
        .select(*key, F.explode(F.array(F.struct(F.col("lo").alias("i"), F.lit(1).alias("d")),
                                        F.struct(F.col("hi").alias("i"), F.lit(-1).alias("d")))).alias("m"))
        .groupBy(*key, F.col("m.i").alias("i"))
        .agg(F.sum("m.d").alias("d"))
    )
    # at most (#thetas + 1) x 30 x 4 x 2 x 2 rows from here on
    steps = marks.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("i", "d"))).alias("_m"))
    full = steps.select(
        *key, "_m", F.posexplode(arr).alias("i", "theta")
    ).withColumn("d", F.coalesce(F.element_at("_m", F.col("i")), F.lit(0)))
    w = W.partitionBy(*key).orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    return full.select("theta", *key, F.sum("d").over(w).alias("n")).where("n > 0")


def histogram_summary(hist: DataFrame, by: Sequence[str] = ("theta",)) -> DataFrame:
    """Policy summary from decision counts: n, mean_k, p95_k, forced rate, accuracy, rates."""
    n = F.sum("n")
    known = F.when(F.col("known"), F.col("n")).otherwise(F.lit(0))
    unk = F.when(~F.col("known"), F.col("n")).otherwise(F.lit(0))
    rejected = F.col("decision").isin(S.REJECT, S.FORCED_REJECT)
    part = lambda c, w: F.sum(F.when(c, w).otherwise(F.lit(0)))
    return hist.groupBy(*by).agg(
        n.alias("n"),
        (F.sum(F.col("k") * F.col("n")) / n).alias("mean_k"),
        F.percentile("k", F.lit(0.95), F.col("n")).alias("p95_k"),
        (part(F.col("decision") >= S.FORCED_COMMIT, F.col("n")) / n).alias("forced_rate"),
        F.try_divide(part(F.col("correct"), known), F.sum(known)).alias("accuracy"),
        F.try_divide(part(rejected, known), F.sum(known)).alias("known_reject_rate"),
        F.try_divide(part(rejected, unk), F.sum(unk)).alias("unknown_reject_rate"),
    )


def sweep(scores: DataFrame, value: str, grid: Sequence[float], **kw) -> DataFrame:
    """Summary row per threshold; ``value`` is ``p_safe`` (with k_min=2) or ``conf``."""
    return histogram_summary(sweep_histogram(record_segments(scores, value, **kw), grid))


def summarize(decisions: DataFrame, by: Sequence[str] = (), more: Sequence[Column] = ()) -> DataFrame:
    """Size, K, and shares of outcomes of decisions, known and unknown flows apart. A rejection of a known
    flow is no hit."""
    known, unk = F.col("label") >= 0, F.col("label") < 0
    rejected = F.col("decision").isin(S.REJECT, S.FORCED_REJECT)
    avg = lambda cond, v: F.avg(F.when(cond, v.cast("double")))
    return decisions.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg("k").alias("mean_k"),
        F.percentile("k", F.lit(0.95)).alias("p95_k"),
        F.avg((F.col("decision") >= S.FORCED_COMMIT).cast("double")).alias("forced_rate"),
        avg(known, F.col("prediction") == F.col("label")).alias("known_accuracy"),
        avg(known, rejected).alias("known_reject_rate"),
        avg(known, F.col("k")).alias("mean_k_known"),
        avg(unk, rejected).alias("unknown_reject_rate"),
        (F.lit(1.0) - avg(unk, rejected)).alias("unknown_committed"),
        avg(unk, F.col("k")).alias("mean_k_unknown"),
        avg(unk & rejected, F.col("k")).alias("rejection_k"),
        *more,
    )


def policy_summary(decisions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``summarize`` with the macro-F1 over known classes and the unknown one (null unless both kinds occur)."""
    from flowtide.operators import metrics as M

    by = list(by)
    rows = summarize(decisions, by, [F.count(F.when(F.col("label") < 0, 1)).alias("_unknown")])
    f1 = M.macro_scores(decisions.select(*by, "label", F.col("prediction").alias("pred")), by=by).select(*by, F.col("macro_f1").alias("_f1"))
    rows = rows.join(f1, by, "left") if by else rows.crossJoin(F.broadcast(f1))
    both = (F.col("_unknown") > 0) & (F.col("_unknown") < F.col("n"))
    return rows.withColumn("open_set_macro_f1", F.when(both, F.col("_f1"))).drop("_f1", "_unknown")


# --- bisection on a step function -----------------------------------------------------------------


def _sums_below(breaks: DataFrame, points: list[float], side: str) -> np.ndarray:
    """Weight of the breakpoints below each point; every task sends one row per point it moves."""
    grid = np.asarray(points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(len(grid) + 1)
        for b in batches:
            i = np.searchsorted(grid, b.column("x").to_numpy(), side=side)
            acc += np.bincount(i, weights=b.column("w").to_numpy(), minlength=len(grid) + 1)
        hit = np.flatnonzero(acc)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(acc[hit])], names=["i", "w"])

    out = np.zeros(len(grid) + 1)
    for r in breaks.select("x", "w").mapInArrow(run, "i bigint, w double").groupBy("i").agg(F.sum("w").alias("w")).collect():
        out[r["i"]] = r["w"]
    return np.cumsum(out)[:-1]


def bisect(
    breaks: DataFrame, value: Callable[[float], float], lo: float, hi: float, to_x: Callable[[float], float],
    mid: Callable[[float, float], float], target: float, iters: int, tol: float | None, side: str, levels: int = 8,
) -> tuple[float, float]:
    """Bisection for a monotone step function ``value(weight below x)``.

    One job evaluates the 2^levels - 1 points the next ``levels`` halvings can visit. Returns the
    final (lo, hi); equal when ``tol`` was met at a point.
    """
    done = 0
    while done < iters:
        depth = min(levels, iters - done)
        bounds = [lo, hi]
        for _ in range(depth):
            fine = [bounds[0]]
            for a, b in zip(bounds, bounds[1:], strict=False):
                fine += [mid(a, b), b]
            bounds = fine
        inner = bounds[1:-1]
        below = _sums_below(breaks, [to_x(v) for v in inner], side)
        got = dict(zip(inner, below, strict=True))
        for _ in range(depth):
            m = mid(lo, hi)
            v = value(got[m])
            if tol is not None and abs(v - target) <= tol:
                return m, m
            lo, hi = (m, hi) if v < target else (lo, m)
        done += depth
    return lo, hi


THETA_RAILS = (0.5, 0.999)


def calibrate_theta(
    scores: DataFrame, target: float, *, tol: float = 0.01, iters: int = 40, k_min: int = 2, **kw
) -> dict[str, float]:
    """The commit threshold whose mean K equals ``target``: theta, reachable, achieved mean K.

    Mean K only steps up where a threshold passes a flow's record high. Equal steps are summed
    before the search, so it never goes back to the flows.
    """
    segs = record_segments(scores, "p_safe", k_min=k_min, keep=("flow_id", "label"), **kw)
    steps = cut(
        segs.groupBy(F.col("above").alias("x")).agg(
            F.sum(F.col("k") - F.coalesce("k_before", F.lit(0))).cast("double").alias("w"), F.count("*").alias("c")
        )
    )
    first = steps.where("x is null").first()
    n, base = first["c"], first["w"]
    breaks = steps.where("x is not null")
    mean = lambda below: (base + below) / n
    # a threshold passes a break when it is strictly above it: breaks equal to it stay out
    ends = _sums_below(breaks, list(THETA_RAILS), "right")
    k_lo, k_hi = mean(ends[0]), mean(ends[1])
    for rail, k in ((THETA_RAILS[0], k_lo), (THETA_RAILS[1], k_hi)):
        if (rail == THETA_RAILS[0] and target <= k) or (rail == THETA_RAILS[1] and target >= k):
            return {"theta": rail, "reachable": float(abs(k - target) <= tol), "mean_k": float(k)}
    lo, hi = bisect(
        breaks, mean, logit(THETA_RAILS[0]), logit(THETA_RAILS[1]), sigmoid, lambda a, b: 0.5 * (a + b),
        target, iters, tol, "right",
    )
    theta = sigmoid(0.5 * (lo + hi))
    got = mean(_sums_below(breaks, [theta], "right")[0])
    return {"theta": theta, "reachable": 1.0, "mean_k": float(got)}


# --- optimal stopping -----------------------------------------------------------------------------


def stop_bin(conf: Column, margin: Column, n_bins: int) -> Column:
    cell = lambda v: F.least(F.greatest(F.floor(v * F.lit(float(n_bins))), F.lit(0)), F.lit(n_bins - 1))
    return (cell(conf) * n_bins + cell(margin)).cast("int")


def _averaged(total: np.ndarray, n: np.ndarray, min_count: int) -> np.ndarray | None:
    """Totals per bin over their counts; bins below ``min_count`` get the overall average. None without counts."""
    if not n.sum():
        return None
    own = np.divide(total, n, out=np.zeros_like(total), where=n > 0)
    return np.where(n < min_count, total.sum(axis=1, keepdims=True) / n.sum(), own)


def fit_optimal_stop(
    val: DataFrame, costs: Sequence[float], *, n_bins: int = 50, min_count: int = 20
) -> DataFrame:
    """Backward induction for every waiting cost at once.

    Flows are read once, into counts of (k, bin, next bin, next is last). The 30 steps run on those
    counts; each brings one value per (cost, bin) back, n_bins^2 x #costs numbers.
    Returns (cost, k, bin, q_commit, q_cont); bin -1 holds what an unseen bin gets.
    """
    steps = F.transform(
        F.arrays_zip("conf", "margin", "pred"),
        lambda v, i: F.struct(
            (i + 1).alias("k"), stop_bin(v["conf"], v["margin"], n_bins).alias("b"),
            (v["pred"] == F.col("label")).cast("int").alias("hit"),
        ),
    )
    last = last_k()
    seen = known_only(val).select(
        last.alias("last"), F.explode(
            F.zip_with(
                F.slice(steps, F.lit(1), last),
                F.slice(F.concat(F.slice(steps, F.lit(2), F.greatest(last - 1, F.lit(0))), F.array(F.lit(None).cast("struct<k:int,b:int,hit:int>"))), F.lit(1), last),
                lambda a, b: F.struct(a.alias("a"), b["b"].alias("nb")),
            )
        ).alias("s"),
    )
    moves = cut(
        seen.groupBy(
            F.col("s.a.k").alias("k"), F.col("s.a.b").alias("b"), F.col("s.nb").alias("nb"),
            (F.col("last") == F.col("s.a.k") + 1).alias("ends"),
        ).agg(F.count("*").alias("n"), F.sum("s.a.hit").alias("hits"))
    )
    spark = val.sparkSession
    s = n_bins * n_bins
    lam = np.asarray([float(c) for c in costs])
    rows: list[pa.Table] = []
    v_end = v_go = None  # value at k + 1 for flows that end there / go on, [costs, bins]
    for k in range(S.K_MAX, 0, -1):
        mine = moves.where(F.col("k") == k)
        if v_end is None:
            here = mine.groupBy("b").agg(
                F.sum("n").alias("n"), F.sum("hits").alias("h"), F.lit(0).alias("c2"), F.array().cast("array<double>").alias("v")
            )
        else:
            table = spark.createDataFrame(
                [(b, e, [float(x) for x in (v_end if e else v_go)[:, b]]) for e in (True, False) for b in range(s)
                 if np.isfinite((v_end if e else v_go)[:, b]).all()],
                "nb int, ends boolean, v array<double>",
            )
            mine = mine.join(F.broadcast(table), ["nb", "ends"], "left")
            go = F.col("nb").isNotNull()
            sums = [F.sum(F.when(go, F.col("n") * F.col("v")[j])).alias(f"v{j}") for j in range(len(lam))]
            here = mine.groupBy("b").agg(
                F.sum("n").alias("n"), F.sum("hits").alias("h"), F.sum(F.when(go, F.col("n")).otherwise(F.lit(0))).alias("c2"), *sums
            ).select("b", "n", "h", "c2", F.array(*[f"v{j}" for j in range(len(lam))]).alias("v"))
        got = here.collect()
        n, h, c2 = np.zeros(s), np.zeros(s), np.zeros(s)
        vs = np.zeros((len(lam), s))
        for r in got:
            n[r["b"]], h[r["b"]], c2[r["b"]] = r["n"], r["h"], r["c2"]
            if r["c2"]:
                vs[:, r["b"]] = r["v"]
        # a bin with too few flows answers with the average over all bins
        right = _averaged(h[None], n, min_count)
        qc = (np.zeros((1, s)) if right is None else right) - lam[:, None] * (k / S.K_MAX)
        later = _averaged(vs, c2, min_count)
        qn = np.full_like(qc, -np.inf) if later is None else later
        v_end, v_go = qc, np.maximum(qc, qn)
        live = np.flatnonzero((n >= min_count) | (c2 >= min_count))
        empty = np.setdiff1d(np.arange(s), np.flatnonzero(n), assume_unique=True)
        default = empty[:1] if len(empty) else np.flatnonzero(n < min_count)[:1]
        for b, name in [(int(x), int(x)) for x in np.union1d(live, np.flatnonzero(n))] + [(int(x), -1) for x in default]:
            rows.append(
                pa.table({"cost": lam, "k": np.full(len(lam), k), "bin": np.full(len(lam), name),
                          "q_commit": qc[:, b], "q_cont": qn[:, b]})
            )
    return spark.createDataFrame(pa.concat_tables(rows))


def optimal_stop(scores: DataFrame, policy: DataFrame, *, n_bins: int = 50, keep: Sequence[str] = KEEP) -> DataFrame:
    """Stop at the first K where committing is worth at least as much as going on.

    ``policy`` holds one cost; its table (30 x n_bins^2 rows at most) is broadcast as one row.
    """
    one = policy.agg(
        F.map_from_entries(
            F.collect_list(
                F.struct(F.col("k") * F.lit(n_bins * n_bins + 1) + F.col("bin") + 1,
                         (F.col("q_commit") >= F.col("q_cont")))
            )
        ).alias("_stop")
    )
    last = last_k()
    seen = scores.crossJoin(F.broadcast(one)).withColumn("_last", last)
    at = lambda k, b: k * F.lit(n_bins * n_bins + 1) + b + 1
    stop = F.transform(
        F.arrays_zip("conf", "margin"),
        lambda v, i: (
            F.coalesce(
                F.element_at("_stop", at((i + 1).cast("bigint"), stop_bin(v["conf"], v["margin"], n_bins).cast("bigint"))),
                F.element_at("_stop", at((i + 1).cast("bigint"), F.lit(-1).cast("bigint"))),
                F.lit(False),
            )
            | (i + 1 == F.col("_last"))
        ) & (i + 1 <= F.col("_last")),
    )
    seen = seen.withColumn("k", F.array_position(stop, True).cast("int"))
    return seen.select(
        *keep, "k",
        F.when(F.col("k") < F.col("_last"), F.lit(S.COMMIT)).otherwise(F.lit(S.FORCED_COMMIT)).alias("decision"),
        F.element_at("pred", F.col("k")).alias("prediction"),
    )
