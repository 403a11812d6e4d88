"""Queries over calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide import bindings as B
from flowtide.functions import draws as R
from flowtide.operators import calibrate as K
from flowtide.operators import metrics as M
from flowtide.operators import scores as C
from flowtide.plans import sql as Q
from flowtide.plans.inputs import em_scored
from flowtide.plans.registry import query
from flowtide.plans.scores import em_logits


@query(
    "prior_adjustment",
    """WITH c AS (SELECT CAST(label AS INTEGER) AS label, count(*) AS n FROM embeddings WHERE vec_id % 5 <= 2 AND label NOT IN (8, 9) GROUP BY label)
SELECT label, round(-ln(least(1.05::DOUBLE, avg(n) OVER () / n)), 6) AS adjustment FROM c""",
)
def prior_adjustment(spark: SparkSession, sf: str) -> DataFrame:
    train = C.known_only(B.em_flows(spark, sf).where("split = 'train'"))
    counts = train.groupBy("label").agg(F.count("*").alias("n"))
    return K.prior_adjustment(counts, 1.05).withColumn("adjustment", F.round("adjustment", 6))


TEMPS = [0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0]


@query(
    "temperature_grid",
    Q.EM_LOGITS + """, tt AS (SELECT unnest([0.25::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE, 4.0::DOUBLE, 8.0::DOUBLE, 16.0::DOUBLE]) AS t),
 m AS (SELECT flow_id, k, any_value(label) AS label, max(z) AS m FROM ef WHERE split = 'val' AND label >= 0 AND k <= ppi_len GROUP BY 1, 2),
 l AS (SELECT ef.flow_id, ef.k, t, any_value(m.m) / t + ln(sum(exp((ef.z - m.m) / t))) - max(ef.z) FILTER (ef.c = m.label) / t AS nll
  FROM ef JOIN m ON m.flow_id = ef.flow_id AND m.k = ef.k CROSS JOIN tt GROUP BY ef.flow_id, ef.k, t),
 g AS (SELECT k, t, avg(nll) AS nll FROM l GROUP BY k, t)
SELECT k, round(arg_min(t, nll), 6) AS t, round(min(nll), 6) AS nll FROM g GROUP BY k""",
)
def temperature_grid(spark: SparkSession, sf: str) -> DataFrame:
    rows = K.logit_rows(em_logits(spark, sf).where("split = 'val'"), B.EM_CLASSES)
    grid = K.temperature_grid(rows, TEMPS)
    return grid.groupBy("k").agg(F.round(F.min_by("t", "nll"), 6).alias("t"), F.round(F.min("nll"), 6).alias("nll"))


@query("temperature_fit")
def temperature_fit(spark: SparkSession, sf: str) -> DataFrame:
    rows = K.logit_rows(em_logits(spark, sf).where("split = 'val'"), B.EM_CLASSES).persist()
    temps = K.fit_temperatures(rows)
    rows.unpersist()
    return spark.createDataFrame(list(enumerate(temps, 1)), "k int, temperature double")


def safe_rows(spark: SparkSession, sf: str, split: str) -> DataFrame:
    rows = C.long_scores(C.known_only(em_scored(spark, sf).where(F.col("split") == split)), ["conf", "pred"], ["flow_id", "label", "ppi_len"])
    return C.reached(rows)


def xy(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("conf").alias("x"), (F.col("pred") == F.col("label")).cast("double").alias("y"))


#: the fit at x is the largest, over starts a up to x, of the smallest mean of a piece from a to beyond x
ISOTONIC_SQL = """vx AS (SELECT conf AS x, CAST(count(*) FILTER (pred = label) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS w FROM sc WHERE split = 'val' AND label >= 0 AND k <= ppi_len GROUP BY conf),
cu AS MATERIALIZED (SELECT x, s, w, row_number() OVER (ORDER BY x) AS i, sum(s) OVER (ORDER BY x) AS cs, sum(w) OVER (ORDER BY x) AS cw FROM vx),
mn AS (SELECT b.x, min((b.cs - a.cs + a.s) / (b.cw - a.cw + a.w)) OVER (PARTITION BY a.i ORDER BY b.i DESC ROWS UNBOUNDED PRECEDING) AS m FROM cu a JOIN cu b ON b.i >= a.i),
iso AS MATERIALIZED (SELECT x, max(m) AS y FROM mn GROUP BY x)"""


@query(
    "isotonic_map",
    Q.EM_SCORED + f""", {ISOTONIC_SQL}, t AS (SELECT flow_id, k, conf AS x FROM sc WHERE split = 'test' AND label >= 0 AND k <= ppi_len)
SELECT flow_id, k, round(CASE WHEN lo.x IS NULL THEN hi.y WHEN hi.x IS NULL OR hi.x = lo.x THEN lo.y ELSE lo.y + (t.x - lo.x) / (hi.x - lo.x) * (hi.y - lo.y) END, 6) AS p_correct
FROM t ASOF LEFT JOIN iso lo ON t.x >= lo.x ASOF LEFT JOIN iso hi ON t.x <= hi.x""",
)
def isotonic_map(spark: SparkSession, sf: str) -> DataFrame:
    """Fitted on all validation prefixes, applied to the test prefixes."""
    m = K.fit_isotonic(xy(safe_rows(spark, sf, "val")))
    test = safe_rows(spark, sf, "test")
    return test.select("flow_id", "k", F.round(m.of(F.col("conf")), 6).alias("p_correct"))


@query("platt_map")
def platt_map(spark: SparkSession, sf: str) -> DataFrame:
    m = K.fit_platt(xy(safe_rows(spark, sf, "val")))
    test = safe_rows(spark, sf, "test")
    return test.select("flow_id", "k", F.round(m.of(F.col("conf")), 6).alias("p_correct"))


@query(
    "safe_map_choice",
    Q.EM_LOGITS + """, v AS (SELECT least(ppi_len, 30) AS n FROM em WHERE label >= 0 AND split = 'val'),
 g AS (SELECT CAST(k AS INTEGER) AS k, (SELECT count(*) FROM v WHERE v.n >= k) AS n FROM range(1, 31) t(k))
SELECT CAST(n AS BIGINT) AS n, k, CASE WHEN n = 0 THEN 'constant' WHEN n < 60 THEN 'platt' ELSE 'isotonic' END AS kind FROM g""",
)
def safe_map_choice(spark: SparkSession, sf: str) -> DataFrame:
    """The kind of map every K gets by the size of its population."""
    rows = safe_rows(spark, sf, "val").groupBy("k").agg(F.count("*").alias("n"))
    sizes = {r["k"]: r["n"] for r in rows.collect()}
    table = [(sizes.get(k, 0), k, K.choose_kind(sizes.get(k, 0), 60)) for k in range(1, 31)]
    return spark.createDataFrame(table, "n bigint, k int, kind string")


@query(
    "calibration_population",
    Q.EM_LOGITS + " SELECT g.k, CAST(count(*) AS BIGINT) AS n FROM em, (SELECT CAST(unnest(range(1, 31)) AS INTEGER) AS k) g WHERE label >= 0 AND ppi_len >= g.k AND split = 'val' GROUP BY g.k",
)
def calibration_population(spark: SparkSession, sf: str) -> DataFrame:
    val = B.em_flows(spark, sf).where("split = 'val'")
    # the population at K is every known flow that reaches K: one pass for all K
    reached = K.population(val, 1).select(F.explode(F.sequence(F.lit(1), F.least("ppi_len", F.lit(30)))).alias("k"))
    return reached.groupBy("k").agg(F.count("*").alias("n"))


@query(
    "calibration_cap",
    Q.EM_LOGITS + " SELECT k, CAST(least(count(*), 20) AS BIGINT) AS n FROM (SELECT unnest(range(1, least(ppi_len, 30) + 1)) AS k FROM em WHERE label >= 0 AND split = 'val') GROUP BY k",
)
def calibration_cap(spark: SparkSession, sf: str) -> DataFrame:
    rows = K.capped(safe_rows(spark, sf, "val"), "k", 20, R.hashed(0))
    return rows.groupBy("k").agg(F.count("*").alias("n"))


ADJ = [0.0, 0.1, -0.2, 0.3, 0.0, -0.1, 0.2, 0.0]
ADJ_SQL = "[" + ",".join(f"{a}::DOUBLE" for a in ADJ) + "][c+1]"
TEMP_SQL = "(1.0::DOUBLE + least(k, ppi_len) / 10.0::DOUBLE)"


def calibrated(spark: SparkSession, sf: str) -> DataFrame:
    temps = [1.0 + k / 10.0 for k in range(1, 31)]
    cal = K.Calibration("centroid-1", ADJ, temps, {k: K.Line(2.0, -1.0) for k in range(1, 31)}).of("centroid-1")
    s = C.class_scores(em_logits(spark, sf), B.EM_CLASSES, cal.adjustment, cal.temperatures, digits=6)
    rows = C.reached(C.long_scores(s, ["pred", "conf"], ["flow_id", "label", "split", "ppi_len"]))
    return cal.with_probability(rows)


@query(
    "calibration_apply",
    Q.EM_LOGITS + f", {Q.class_scores_sql(ADJ_SQL, TEMP_SQL)} SELECT flow_id, k, pred, round(conf, 6) AS conf, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-(2.0::DOUBLE * conf - 1.0::DOUBLE))), 6) AS p_correct FROM cs WHERE k <= ppi_len",
)
def calibration_apply(spark: SparkSession, sf: str) -> DataFrame:
    return calibrated(spark, sf).select(
        "flow_id", "k", "pred", F.round("conf", 6).alias("conf"), F.round("p_correct", 6).alias("p_correct")
    )


def _bins(c: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {c} > {i / 15!r}::DOUBLE THEN 1 ELSE 0 END" for i in range(1, 15)) + ")"


@query(
    "calibration_error_per_k",
    Q.EM_LOGITS + f""", {Q.class_scores_sql(ADJ_SQL, TEMP_SQL)}, r AS (SELECT k, conf, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(2.0::DOUBLE * conf - 1.0::DOUBLE))) AS sp, CASE WHEN pred = label THEN 1.0::DOUBLE ELSE 0 END AS hit
  FROM cs WHERE split = 'test' AND label >= 0 AND k <= ppi_len),
 a AS (SELECT k, {_bins('conf')} AS b, count(*) AS n, abs(avg(conf) - avg(hit)) AS g FROM r GROUP BY 1, 2),
 s AS (SELECT k, {_bins('sp')} AS b, count(*) AS n, abs(avg(sp) - avg(hit)) AS g FROM r GROUP BY 1, 2)
SELECT x.k, x.ece, x.n, y.safe_ece FROM (SELECT k, round(sum(n * g) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM a GROUP BY k) x
 JOIN (SELECT k, round(sum(n * g) / sum(n), 6) AS safe_ece FROM s GROUP BY k) y USING (k)""",
)
def calibration_error_per_k(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.known_only(calibrated(spark, sf)).where("split = 'test'")
    a = M.ece(rows, "conf", M.is_correct(), ["k"])
    b = M.ece(rows, "p_correct", M.is_correct(), ["k"]).select("k", F.col("ece").alias("safe_ece"))
    return a.join(b, "k").select("k", F.round("ece", 6).alias("ece"), "n", F.round("safe_ece", 6).alias("safe_ece"))
