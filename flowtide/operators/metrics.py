"""Metrics as aggregations. Every function takes ``by``: the columns a metric is grouped by.

Counts are summed before the shuffle; metrics that need a global order use ``ordered``, which
spreads one group over many partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowtide import schema as S
from flowtide.operators.ordered import average_ranks, running_totals

# --- classification ------------------------------------------------------------------------------


def is_correct(pred: str = "pred", label: str = "label") -> Column:
    return (F.col(pred) == F.col(label)).cast("double")


def accuracy(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(is_correct()).alias("accuracy"))


def short_flow_accuracy(rows: DataFrame, by: Sequence[str] = ("k",)) -> DataFrame:
    """Accuracy of flows shorter than K; NULL where there are none."""
    short = F.col("ppi_len") < F.col("k")
    return rows.groupBy(*by).agg(
        F.count(F.when(short, 1)).alias("n_short"),
        F.avg(F.when(short, is_correct())).alias("short_accuracy"),
    )


def confusion(rows: DataFrame, classes: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(…, label, pred, n) over a class list (default: classes present in the labels).

    Pairs outside the list are dropped, cells nobody hit are there with 0. The class list is a
    dimension: its square is the size of the result.
    """
    by = list(by)
    counts = rows.groupBy(*by, "label", "pred").agg(F.count("*").alias("n"))
    if classes is None:
        classes = counts.select(*by, F.col("label").alias("c")).distinct()
    else:
        classes = classes.select(*[c for c in by if c in classes.columns], "c")
        missing = [c for c in by if c not in classes.columns]
        if missing:
            classes = counts.select(*missing).distinct().crossJoin(F.broadcast(classes))
    truth = classes.withColumnRenamed("c", "label")
    guess = classes.withColumnRenamed("c", "pred")
    grid = truth.join(guess, by) if by else truth.crossJoin(guess)
    return grid.join(counts, [*by, "label", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def per_class(rows: DataFrame, classes: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Support, precision, recall and F1 of classes with support; 0/0 counts as 0."""
    by = list(by)
    cells = rows.groupBy(*by, "label", "pred").agg(F.count("*").alias("n"))
    if classes is None:
        listed = cells.select(*by, F.col("label").alias("c")).distinct()
    else:
        listed = classes
    on = [c for c in [*by, "c"] if c in listed.columns]
    inside = cells.join(
        F.broadcast(listed.withColumnRenamed("c", "label")), [c if c != "c" else "label" for c in on], "left_semi"
    ).join(
        F.broadcast(listed.withColumnRenamed("c", "pred")), [c if c != "c" else "pred" for c in on], "left_semi"
    )
    sides = inside.select(
        *by,
        F.explode(
            F.array(
                F.struct(
                    F.col("label").alias("c"), F.col("n").alias("sup"), F.lit(0).cast("bigint").alias("prd"),
                    F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(F.lit(0)).alias("tp"),
                ),
                F.struct(
                    F.col("pred").alias("c"), F.lit(0).cast("bigint").alias("sup"), F.col("n").alias("prd"),
                    F.lit(0).cast("bigint").alias("tp"),
                ),
            )
        ).alias("e"),
    )
    agg = sides.groupBy(*by, F.col("e.c").alias("c")).agg(
        F.sum("e.sup").alias("support"), F.sum("e.prd").alias("predicted"), F.sum("e.tp").alias("tp")
    )
    agg = agg.where("support > 0")
    p = F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0))
    r = F.col("tp") / F.col("support")
    return agg.select(
        *by, "c", "support", p.alias("precision"), r.alias("recall"),
        F.coalesce(F.try_divide(F.lit(2.0) * p * r, p + r), F.lit(0.0)).alias("f1"),
    )


def macro_scores(rows: DataFrame, classes: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Macro-F1 and balanced accuracy over classes with support."""
    return per_class(rows, classes, by).groupBy(*by).agg(
        F.avg("f1").alias("macro_f1"), F.avg("recall").alias("balanced_accuracy")
    )


# --- earliness -----------------------------------------------------------------------------------


def auc_k(curve: DataFrame, ks: Sequence[int] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Mean of acc@K over a set of K (default: every K of the curve)."""
    rows = curve if ks is None else curve.where(F.col("k").isin(list(ks)))
    return rows.groupBy(*by).agg(F.avg("accuracy").alias("auc_k"))


def k95(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Smallest K whose accuracy is at least 95 % of the accuracy at the largest K."""
    w = W.partitionBy(*by)
    marked = curve.withColumn("_goal", F.lit(0.95) * F.max_by("accuracy", "k").over(w))
    return marked.groupBy(*by).agg(F.min(F.when(F.col("accuracy") >= F.col("_goal"), F.col("k"))).alias("k95"))


def harmonic_earliness(acc: Column, mean_k: Column, k_max: int = S.K_MAX) -> Column:
    early = F.lit(1.0) - mean_k / F.lit(float(k_max))
    return F.when(acc + early <= 0, F.lit(0.0)).otherwise(F.lit(2.0) * acc * early / (acc + early))


def policy_metrics(decisions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and 95th percentile of K, coverage (not forced), accuracy of committed flows.

    K has 30 values, so the exact percentile keeps 30 counters per group.
    """
    own = F.col("decision") <= S.REJECT
    return decisions.groupBy(*by).agg(
        F.avg("k").alias("mean_k"),
        F.percentile("k", F.lit(0.95)).alias("p95_k"),
        F.avg(own.cast("double")).alias("coverage"),
        F.coalesce(
            F.avg(F.when(own, (F.col("prediction") == F.col("label")).cast("double"))), F.lit(0.0)
        ).alias("committed_accuracy"),
    )


def pareto_front(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Points (mean_k, accuracy) no other point dominates. A sweep has a few hundred points."""
    w = W.partitionBy(*by).orderBy("mean_k", "accuracy").rowsBetween(W.unboundedPreceding, -1)
    best = F.max("accuracy").over(w)
    return points.withColumn("_b", best).where(F.col("_b").isNull() | (F.col("accuracy") > F.col("_b"))).drop("_b")


def accuracy_at_budget(points: DataFrame, budgets: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Best accuracy among points with mean K within the budget; 0 when there is none."""
    wide = points.select(*by, "mean_k", "accuracy", F.explode(F.array(*[F.lit(float(b)) for b in budgets])).alias("budget"))
    return wide.groupBy(*by, "budget").agg(
        F.coalesce(F.max(F.when(F.col("mean_k") <= F.col("budget"), F.col("accuracy"))), F.lit(0.0)).alias("accuracy")
    )


def budgets(lo: float = 2.0, hi: float = 12.0, n: int = 201) -> list[float]:
    return [lo + (hi - lo) * i / (n - 1) for i in range(n)]


def pareto_area(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the best accuracy within budget over 201 budgets from 2 to 12 packets."""
    return accuracy_at_budget(points, budgets(), by).groupBy(*by).agg(F.avg("accuracy").alias("pareto_area"))


# --- open set ------------------------------------------------------------------------------------


def auroc(rows: DataFrame, score: str, positive: Column, by: Sequence[str] = ()) -> DataFrame:
    """Mann-Whitney AUROC with average ranks for ties; NULL where a class is missing.

    Rows are counted per distinct score first, then ranks are running totals of those counts.
    """
    by = list(by)
    counted = rows.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("_x")).agg(
        F.count("*").alias("_n"), F.sum(positive.cast("bigint")).alias("_p")
    )
    cum = running_totals(counted, by, ["_x"], {"_cum": "_n", "_pos": "_p"})
    rank = F.col("_cum") - F.col("_n") + (F.col("_n") + 1) / F.lit(2.0)
    n_pos = F.sum("_p")
    n_neg = F.sum("_n") - F.sum("_p")
    u = F.sum(F.col("_p") * rank) - n_pos * (n_pos + 1) / F.lit(2.0)
    return cum.groupBy(*by).agg(
        F.when((n_pos > 0) & (n_neg > 0), u / (n_pos * n_neg)).alias("auroc"),
        n_pos.alias("n_pos"),
        n_neg.alias("n_neg"),
    )


def _descending(rows: DataFrame, score: str, positive: Column, by: Sequence[str], row_id: str) -> DataFrame:
    base = rows.where(F.col(score).isNotNull()).select(
        *by, F.col(score).alias("_x"), F.col(row_id).alias("_id"), positive.cast("bigint").alias("_y")
    )
    return running_totals(
        base, by, [F.col("_x").desc(), F.col("_id")], {"rn": F.lit(1).cast("bigint"), "tp": "_y"}
    )


def average_precision(
    rows: DataFrame, score: str, positive: Column, by: Sequence[str] = (), row_id: str = "flow_id"
) -> DataFrame:
    """Sum of precision at each positive over the number of positives, ties in row order."""
    r = _descending(rows, score, positive, by, row_id)
    gain = F.when(F.col("_y") == 1, F.col("tp") / F.col("rn"))
    return r.groupBy(*by).agg((F.sum(gain) / F.max("tp_total")).alias("aupr"))


def fpr_at_tpr(
    rows: DataFrame, score: str, positive: Column, target: float = 0.95, by: Sequence[str] = (),
    row_id: str = "flow_id",
) -> DataFrame:
    """False-positive rate at the first point whose true-positive rate reaches the target."""
    r = _descending(rows, score, positive, by, row_id)
    tpr = F.col("tp") / F.col("tp_total")
    fpr = (F.col("rn") - F.col("tp")) / (F.col("rn_total") - F.col("tp_total"))
    both = (F.max("tp_total") > 0) & (F.max("rn_total") > F.max("tp_total"))
    return r.groupBy(*by).agg(
        F.when(both, F.coalesce(F.min_by(fpr, F.when(tpr >= target, F.col("rn"))), F.lit(1.0))).alias("fpr")
    )


def rejection_earliness(decisions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean K of correctly rejected unknown flows; NULL if there are none."""
    hit = (F.col("label") < 0) & (F.col("prediction") < 0)
    return decisions.groupBy(*by).agg(F.avg(F.when(hit, F.col("k"))).alias("rejection_k"))


# --- calibration ---------------------------------------------------------------------------------


def confidence_bin(conf: Column, n_bins: int = 15) -> Column:
    """Equal bins (lo, hi]: the number of interior edges strictly below the value."""
    out = F.lit(0)
    for i in range(1, n_bins):
        out = out + (conf > F.lit(i / n_bins)).cast("int")
    return out


def _bins(rows: DataFrame, conf: str, correct: Column, by: Sequence[str], n_bins: int) -> DataFrame:
    return rows.groupBy(*by, confidence_bin(F.col(conf), n_bins).alias("bin")).agg(
        F.count("*").alias("n"),
        F.avg(conf).alias("confidence"),
        F.avg(correct.cast("double")).alias("accuracy"),
    )


def ece(rows: DataFrame, conf: str, correct: Column, by: Sequence[str] = (), n_bins: int = 15) -> DataFrame:
    gap = F.abs(F.col("confidence") - F.col("accuracy"))
    return _bins(rows, conf, correct, by, n_bins).groupBy(*by).agg(
        (F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.sum("n").alias("n")
    )


def reliability(rows: DataFrame, conf: str, correct: Column, by: Sequence[str] = (), n_bins: int = 15) -> DataFrame:
    """Accuracy and confidence per bin; empty bins are there with NULLs."""
    seen = _bins(rows, conf, correct, by, n_bins)
    bins = F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin")
    groups = seen.select(*by).distinct() if by else rows.sparkSession.range(1).select()
    grid = groups.select(*by, bins) if by else rows.sparkSession.range(1).select(bins)
    return grid.join(seen, [*by, "bin"], "left").select(
        *by, "bin", ((F.col("bin") + F.lit(0.5)) / n_bins).alias("center"), "accuracy", "confidence",
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def nll_at_temperature(logits: DataFrame, temperature: float, by: Sequence[str] = ("k",)) -> DataFrame:
    """Mean negative log-likelihood of the true class from flat logits per row (array ``zk``)."""
    t = F.lit(float(temperature))
    m = F.array_max("zk")
    lse = m / t + F.log(F.aggregate("zk", F.lit(0.0), lambda a, v: a + F.exp((v - m) / t)))
    nll = lse - F.element_at("zk", F.col("label") + 1) / t
    return logits.groupBy(*by).agg(F.avg(nll).alias("nll"))


# --- rank correlation, seeds ----------------------------------------------------------------------


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation; NULL for fewer than 3 pairs or a constant side."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    pairs = ok.select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
    ranked = average_ranks(average_ranks(pairs, by, "_x", "_rx"), by, "_y", "_ry")
    good = (F.count("*") >= 3) & (F.stddev_pop("_rx") > 0) & (F.stddev_pop("_ry") > 0)
    return ranked.groupBy(*by).agg(
        F.when(good, F.corr("_rx", "_ry")).alias("spearman"), F.count("*").alias("n")
    )


def over_seeds(rows: DataFrame, value: str, by: Sequence[str], sample: bool = False) -> DataFrame:
    """Mean, deviation and number of seeds; one seed has deviation 0."""
    sd = F.stddev_samp(value) if sample else F.stddev_pop(value)
    return rows.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.coalesce(sd, F.lit(0.0)).alias("std"), F.count(value).alias("n")
    )
