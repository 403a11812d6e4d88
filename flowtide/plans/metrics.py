"""Queries over metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.operators import metrics as M
from flowtide.operators import policies as H
from flowtide.operators import scores as C
from flowtide.plans import sql as Q
from flowtide.plans.inputs import em_scored, em_scores
from flowtide.plans.policies import ECHO_SQL, SAFE_SQL, sweep_points
from flowtide.plans.registry import query
from flowtide.plans.scores import em_logits

ACC = "avg(CASE WHEN pred = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


def test_rows(spark: SparkSession, sf: str, names: list[str], keep: list[str] | None = None) -> DataFrame:
    s = C.known_only(em_scored(spark, sf).where("split = 'test'"))
    return C.long_scores(s, names, keep or ["flow_id", "label", "ppi_len", "period"])


CURVE_SQL = f"cv AS (SELECT k, {ACC} AS accuracy FROM sc WHERE split = 'test' AND label >= 0 GROUP BY k)"


@query("accuracy_at_k", Q.EM_SCORED + f", {CURVE_SQL} SELECT k, round(accuracy, 6) AS accuracy FROM cv")
def accuracy_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return M.accuracy(test_rows(spark, sf, ["pred"]), ["k"]).withColumn("accuracy", F.round("accuracy", 6))


@query(
    "short_flow_accuracy",
    Q.EM_SCORED + """ SELECT k, CAST(count(*) FILTER (ppi_len < k) AS BIGINT) AS n_short,
 round(avg(CASE WHEN pred = label THEN 1.0::DOUBLE ELSE 0 END) FILTER (ppi_len < k), 6) AS short_accuracy
 FROM sc WHERE split = 'test' AND label >= 0 GROUP BY k""",
)
def short_flow_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    out = M.short_flow_accuracy(test_rows(spark, sf, ["pred"]))
    return out.withColumn("short_accuracy", F.round("short_accuracy", 6))


CELLS = "ce AS (SELECT k, label, pred, count(*) AS n FROM sc WHERE split = 'test' AND label >= 0 GROUP BY 1, 2, 3), cl AS (SELECT DISTINCT k, label AS c FROM ce)"


@query(
    "confusion_matrix",
    Q.EM_SCORED + f""", {CELLS} SELECT a.k, a.c AS label, b.c AS pred, CAST(coalesce(ce.n, 0) AS BIGINT) AS n
 FROM cl a JOIN cl b ON a.k = b.k LEFT JOIN ce ON ce.k = a.k AND ce.label = a.c AND ce.pred = b.c""",
)
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return M.confusion(test_rows(spark, sf, ["pred"]), by=["k"])


PER_CLASS = """pc AS (SELECT cl.k, cl.c, coalesce(sum(n) FILTER (ce.label = c AND list_contains(cs, ce.pred)), 0) AS support,
 coalesce(sum(n) FILTER (ce.pred = c), 0) AS predicted, coalesce(sum(n) FILTER (ce.label = c AND ce.pred = c), 0) AS tp
 FROM cl JOIN (SELECT k, list(c) AS cs FROM cl GROUP BY k) lc ON lc.k = cl.k JOIN ce ON ce.k = cl.k GROUP BY 1, 2),
 pf AS (SELECT k, c, support, CASE WHEN predicted > 0 THEN tp::DOUBLE / predicted ELSE 0 END AS p, tp::DOUBLE / support AS r FROM pc WHERE support > 0),
 f1 AS (SELECT *, CASE WHEN p + r > 0 THEN 2.0::DOUBLE * p * r / (p + r) ELSE 0 END AS f1 FROM pf)"""


@query(
    "per_class_f1",
    Q.EM_SCORED + f", {CELLS}, {PER_CLASS} SELECT k, c, CAST(support AS BIGINT) AS support, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM f1",
)
def per_class_f1(spark: SparkSession, sf: str) -> DataFrame:
    out = M.per_class(test_rows(spark, sf, ["pred"]), by=["k"])
    return out.select("k", "c", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "macro_f1",
    Q.EM_SCORED + f", {CELLS}, {PER_CLASS} SELECT k, round(avg(f1), 6) AS macro_f1, round(avg(r), 6) AS balanced_accuracy FROM f1 GROUP BY k",
)
def macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    out = M.macro_scores(test_rows(spark, sf, ["pred"]), by=["k"])
    return out.select("k", F.round("macro_f1", 6).alias("macro_f1"), F.round("balanced_accuracy", 6).alias("balanced_accuracy"))


@query(
    "area_over_k",
    Q.EM_SCORED + f", {CURVE_SQL} SELECT round(avg(accuracy), 6) AS auc_k FROM cv WHERE k IN (1,2,3,4,5,6,8,10,12,15,20,25,30)",
)
def area_over_k(spark: SparkSession, sf: str) -> DataFrame:
    from flowtide.schema import K_GRID

    curve = M.accuracy(test_rows(spark, sf, ["pred"]), ["k"])
    return M.auc_k(curve, K_GRID).withColumn("auc_k", F.round("auc_k", 6))


@query(
    "causal_accuracy_curve",
    Q.EM_LOGITS + """, pr AS (SELECT flow_id, k, CAST(arg_min(c, -z * 1.0::DOUBLE) AS INTEGER) AS pred FROM lg GROUP BY 1, 2)
SELECT g.k, round(avg(CASE WHEN pr.pred = em.label THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy
FROM em CROSS JOIN (SELECT CAST(unnest(range(1, 31)) AS INTEGER) AS k) g JOIN pr ON pr.flow_id = em.flow_id AND pr.k = least(g.k, em.ppi_len)
WHERE split = 'test' AND label >= 0 GROUP BY g.k""",
)
def causal_accuracy_curve(spark: SparkSession, sf: str) -> DataFrame:
    """From per-position predictions read at the effective K."""
    from flowtide import bindings as B

    z = C.known_only(em_logits(spark, sf).where("split = 'test'"))
    rows = C.read_at(z, list(range(1, 31)), B.EM_CLASSES, keep=["flow_id", "label"])
    best = rows.groupBy("flow_id", "label", "k").agg(
        F.max_by("c", F.struct("z", -F.col("c"))).alias("pred")
    )
    return M.accuracy(best, ["k"]).withColumn("accuracy", F.round("accuracy", 6))


@query(
    "smallest_k_95",
    Q.EM_SCORED + f", {CURVE_SQL} SELECT min(k) AS k95 FROM cv WHERE accuracy >= 0.95::DOUBLE * (SELECT accuracy FROM cv WHERE k = 30)",
)
def smallest_k_95(spark: SparkSession, sf: str) -> DataFrame:
    return M.k95(M.accuracy(test_rows(spark, sf, ["pred"]), ["k"]))


DEC_KNOWN = "(SELECT * FROM de WHERE label >= 0)"


@query(
    "harmonic_earliness",
    Q.EM_SCORED + f""", {ECHO_SQL}, a AS (SELECT avg(CASE WHEN prediction = label THEN 1.0::DOUBLE ELSE 0 END) AS acc, 1.0::DOUBLE - avg(k) / 30.0::DOUBLE AS e FROM {DEC_KNOWN})
SELECT round(CASE WHEN acc + e <= 0 THEN 0 ELSE 2.0::DOUBLE * acc * e / (acc + e) END, 6) AS earliness FROM a""",
)
def harmonic_earliness(spark: SparkSession, sf: str) -> DataFrame:
    d = H.confidence_stop(em_scored(spark, sf).where("split = 'test'"), 0.5)
    a = C.known_only(d).agg(
        F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("acc"), F.avg("k").alias("mk")
    )
    return a.select(F.round(M.harmonic_earliness(F.col("acc"), F.col("mk")), 6).alias("earliness"))


@query(
    "policy_metrics",
    Q.EM_SCORED + f""", {ECHO_SQL} SELECT round(avg(k), 6) AS mean_k, round(quantile_cont(k, 0.95::DOUBLE), 6) AS p95_k,
 round(avg(CASE WHEN decision <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage,
 round(coalesce(avg(CASE WHEN prediction = label THEN 1.0::DOUBLE ELSE 0 END) FILTER (decision <= 1), 0), 6) AS committed_accuracy FROM {DEC_KNOWN}""",
)
def policy_metrics(spark: SparkSession, sf: str) -> DataFrame:
    d = C.known_only(H.confidence_stop(em_scored(spark, sf).where("split = 'test'"), 0.5))
    out = M.policy_metrics(d)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


POINTS_SQL = """tg AS (SELECT CAST(unnest(range(1, 20)) AS DOUBLE) * 0.05::DOUBLE AS theta),
dq AS (SELECT tg.theta, f.flow_id, f.label, coalesce(min(s.k) FILTER (s.conf >= tg.theta), f.ppi_len) AS k
  FROM tg CROSS JOIN (SELECT * FROM em WHERE split = 'test' AND label >= 0) f JOIN sc s ON s.flow_id = f.flow_id AND s.k <= f.ppi_len GROUP BY tg.theta, f.flow_id, f.label, f.ppi_len),
pt AS (SELECT theta, avg(dq.k) AS mean_k, avg(CASE WHEN sc.pred = dq.label THEN 1.0::DOUBLE ELSE 0 END) AS accuracy
  FROM dq JOIN sc ON sc.flow_id = dq.flow_id AND sc.k = dq.k GROUP BY theta)"""


@query(
    "pareto_front",
    Q.EM_SCORED + f""", {POINTS_SQL} SELECT round(mean_k, 6) AS mean_k, round(accuracy, 6) AS accuracy FROM (SELECT DISTINCT mean_k, accuracy FROM pt) a
 WHERE NOT EXISTS (SELECT 1 FROM pt b WHERE (b.mean_k < a.mean_k AND b.accuracy >= a.accuracy) OR (b.mean_k = a.mean_k AND b.accuracy > a.accuracy))""",
)
def pareto_front(spark: SparkSession, sf: str) -> DataFrame:
    # of equal points only the first counts as an improvement
    front = M.pareto_front(sweep_points(spark, sf).select("mean_k", "accuracy").distinct())
    best = front.groupBy("accuracy").agg(F.min("mean_k").alias("mean_k"))
    top = best.groupBy("mean_k").agg(F.max("accuracy").alias("accuracy"))
    return top.select(F.round("mean_k", 6).alias("mean_k"), F.round("accuracy", 6).alias("accuracy"))


@query(
    "accuracy_within_budget",
    Q.EM_SCORED + f""", {POINTS_SQL} SELECT b AS budget, round(coalesce(max(accuracy) FILTER (mean_k <= b), 0), 6) AS accuracy
 FROM pt CROSS JOIN (SELECT unnest([4.0::DOUBLE, 6.0::DOUBLE, 8.0::DOUBLE]) AS b) GROUP BY b""",
)
def accuracy_within_budget(spark: SparkSession, sf: str) -> DataFrame:
    out = M.accuracy_at_budget(sweep_points(spark, sf), [4.0, 6.0, 8.0])
    return out.withColumn("accuracy", F.round("accuracy", 6))


@query(
    "pareto_area",
    Q.EM_SCORED + f""", {POINTS_SQL}, bb AS (SELECT 2.0::DOUBLE + 10.0::DOUBLE * i / 200 AS b FROM range(0, 201) r(i)),
 ab AS (SELECT b, coalesce(max(accuracy) FILTER (mean_k <= b), 0) AS a FROM pt CROSS JOIN bb GROUP BY b)
SELECT round(avg(a), 6) AS pareto_area FROM ab""",
)
def pareto_area(spark: SparkSession, sf: str) -> DataFrame:
    return M.pareto_area(sweep_points(spark, sf)).withColumn("pareto_area", F.round("pareto_area", 6))


TEST_U = "t AS (SELECT flow_id, k, u, label < 0 AS y FROM su WHERE split = 'test')"


def unknown_rows(spark: SparkSession, sf: str) -> DataFrame:
    return C.long_scores(em_scores(spark, sf).where("split = 'test'"), ["u"], ["flow_id", "label"])


@query(
    "auroc",
    Q.EM_SCORES + f""", {TEST_U}, r AS (SELECT k, y, rank() OVER (PARTITION BY k ORDER BY u) + (count(*) OVER (PARTITION BY k, u) - 1) / 2.0::DOUBLE AS rk FROM t)
SELECT k, round((sum(rk) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 6) AS auroc,
 CAST(count(*) FILTER (y) AS BIGINT) AS n_pos, CAST(count(*) FILTER (NOT y) AS BIGINT) AS n_neg FROM r GROUP BY k""",
)
def auroc(spark: SparkSession, sf: str) -> DataFrame:
    out = M.auroc(unknown_rows(spark, sf), "u", F.col("label") < 0, ["k"])
    return out.withColumn("auroc", F.round("auroc", 6))


RANKED = """r AS (SELECT k, y, row_number() OVER w AS rn, sum(CASE WHEN y THEN 1 ELSE 0 END) OVER w AS tp,
  sum(CASE WHEN y THEN 1 ELSE 0 END) OVER (PARTITION BY k) AS np, count(*) OVER (PARTITION BY k) AS n FROM t WINDOW w AS (PARTITION BY k ORDER BY u DESC, flow_id))"""


@query(
    "average_precision",
    Q.EM_SCORES + f", {TEST_U}, {RANKED} SELECT k, round(sum(tp::DOUBLE / rn) FILTER (y) / max(np), 6) AS aupr FROM r GROUP BY k",
)
def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    out = M.average_precision(unknown_rows(spark, sf), "u", F.col("label") < 0, ["k"])
    return out.withColumn("aupr", F.round("aupr", 6))


@query(
    "fpr_at_tpr",
    Q.EM_SCORES + f", {TEST_U}, {RANKED} SELECT k, round(coalesce(arg_min((rn - tp)::DOUBLE / (n - np), rn) FILTER (tp::DOUBLE / np >= 0.95::DOUBLE), 1.0::DOUBLE), 6) AS fpr FROM r GROUP BY k",
)
def fpr_at_tpr(spark: SparkSession, sf: str) -> DataFrame:
    out = M.fpr_at_tpr(unknown_rows(spark, sf), "u", F.col("label") < 0, 0.95, ["k"])
    return out.withColumn("fpr", F.round("fpr", 6))


OPEN_CELLS = "ce AS (SELECT 0 AS k, label, prediction AS pred, count(*) AS n FROM de GROUP BY 2, 3), cl AS (SELECT DISTINCT k, label AS c FROM ce)"


@query(
    "open_set_f1",
    Q.EM_SCORES + f", {Q.theta_sql(0.1)}, {SAFE_SQL}, {OPEN_CELLS}, {PER_CLASS} SELECT round(avg(f1), 6) AS macro_f1 FROM f1",
)
def open_set_f1(spark: SparkSession, sf: str) -> DataFrame:
    from flowtide.plans.policies import safe_decisions

    d = safe_decisions(spark, sf)
    out = M.macro_scores(d.select("label", F.col("prediction").alias("pred")))
    return out.select(F.round("macro_f1", 6).alias("macro_f1"))


@query(
    "rejection_earliness",
    Q.EM_SCORES + f", {Q.theta_sql(0.1)}, {SAFE_SQL} SELECT round(avg(k) FILTER (label < 0 AND prediction < 0), 6) AS rejection_k FROM de",
)
def rejection_earliness(spark: SparkSession, sf: str) -> DataFrame:
    from flowtide.plans.policies import safe_decisions

    return M.rejection_earliness(safe_decisions(spark, sf)).withColumn("rejection_k", F.round("rejection_k", 6))


def bin_sql(conf: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {conf} > {i / 15!r}::DOUBLE THEN 1 ELSE 0 END" for i in range(1, 15)) + ")"


BINNED = f"""bn AS (SELECT k, {bin_sql('conf')} AS bin, count(*) AS n, avg(conf) AS c, {ACC} AS a FROM sc WHERE split = 'test' AND label >= 0 GROUP BY 1, 2)"""


@query(
    "expected_calibration_error",
    Q.EM_SCORED + f", {BINNED} SELECT k, round(sum(n * abs(c - a)) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM bn GROUP BY k",
)
def expected_calibration_error(spark: SparkSession, sf: str) -> DataFrame:
    out = M.ece(test_rows(spark, sf, ["pred", "conf"]), "conf", M.is_correct(), ["k"])
    return out.withColumn("ece", F.round("ece", 6))


@query(
    "reliability_curve",
    Q.EM_SCORED + f""", {BINNED} SELECT g.k, CAST(b.i AS INTEGER) AS bin, round((b.i + 0.5::DOUBLE) / 15, 6) AS center, round(x.a, 12) AS accuracy,
 round(x.c, 12) AS confidence, CAST(coalesce(x.n, 0) AS BIGINT) AS n FROM range(0, 15) b(i) CROSS JOIN (SELECT DISTINCT k FROM bn) g LEFT JOIN bn x ON x.bin = b.i AND x.k = g.k""",
)
def reliability_curve(spark: SparkSession, sf: str) -> DataFrame:
    out = M.reliability(test_rows(spark, sf, ["pred", "conf"]), "conf", M.is_correct(), ["k"])
    # means of a few six-digit numbers: fewer digits would make ties
    return out.select("k", "bin", F.round("center", 6).alias("center"), *[F.round(c, 12).alias(c) for c in ("accuracy", "confidence")], "n")


@query(
    "nll_at_temperature",
    Q.EM_LOGITS + """, m AS (SELECT flow_id, k, any_value(label) AS label, max(z) AS m FROM ef WHERE split = 'val' AND label >= 0 AND k <= ppi_len GROUP BY 1, 2),
 l AS (SELECT ef.flow_id, ef.k, any_value(m.m) / 2.5::DOUBLE + ln(sum(exp((ef.z - m.m) / 2.5::DOUBLE))) - max(ef.z) FILTER (ef.c = m.label) / 2.5::DOUBLE AS nll
  FROM ef JOIN m ON m.flow_id = ef.flow_id AND m.k = ef.k GROUP BY 1, 2)
SELECT k, round(avg(nll), 6) AS nll FROM l GROUP BY k""",
)
def nll_at_temperature(spark: SparkSession, sf: str) -> DataFrame:
    from flowtide.operators.calibrate import logit_rows

    rows = logit_rows(em_logits(spark, sf).where("split = 'val'"), 8)
    return M.nll_at_temperature(rows, 2.5).withColumn("nll", F.round("nll", 6))


@query(
    "spearman",
    Q.EM_SCORED + """, t AS (SELECT k, conf AS x, energy_raw AS y FROM sc WHERE split = 'test'),
 r AS (SELECT k, rank() OVER (PARTITION BY k ORDER BY x) + (count(*) OVER (PARTITION BY k, x) - 1) / 2.0::DOUBLE AS rx,
  rank() OVER (PARTITION BY k ORDER BY y) + (count(*) OVER (PARTITION BY k, y) - 1) / 2.0::DOUBLE AS ry FROM t)
SELECT k, round(corr(rx, ry), 6) AS spearman, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY k""",
)
def spearman(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.long_scores(em_scored(spark, sf).where("split = 'test'"), ["conf", "energy_raw"], ["flow_id"])
    out = M.spearman(rows, "conf", "energy_raw", ["k"])
    return out.withColumn("spearman", F.round("spearman", 6))


@query(
    "mean_over_seeds",
    Q.EM_SCORED + f""", a AS (SELECT k, period AS seed, {ACC} AS accuracy FROM sc WHERE split = 'test' AND label >= 0 GROUP BY 1, 2)
SELECT k, round(avg(accuracy), 6) AS mean, round(stddev_pop(accuracy), 6) AS std, CAST(count(*) AS BIGINT) AS n FROM a GROUP BY k""",
)
def mean_over_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Periods play the seeds."""
    acc = M.accuracy(test_rows(spark, sf, ["pred"]), ["k", "period"])
    out = M.over_seeds(acc, "accuracy", ["k"])
    return out.select("k", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")
