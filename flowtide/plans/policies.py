"""Queries over stopping policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide import bindings as B
from flowtide import schema as S
from flowtide.operators import policies as H
from flowtide.operators import scores as C
from flowtide.plans import sql as Q
from flowtide.plans.inputs import em_scored, em_scores
from flowtide.plans.registry import query


def safe_sql(
    theta: str = "0.5::DOUBLE", order: str = "reject_first", where: str = "split = 'test'", src: str = "su",
    th: str | None = "th", name: str = "de", cap: int = 30,
) -> str:
    """Decisions of the safe-stop rule from long scores."""
    wins = "kr <= kc" if order == "reject_first" else "kr < kc"
    rej = f"s.u >= {th}.theta" if th else "FALSE"
    join = f"LEFT JOIN {th} ON {th}.k = s.k" if th else ""
    last = f"least(e.ppi_len, {cap})"
    return f"""{name}0 AS MATERIALIZED (SELECT e.flow_id, any_value(e.label) AS label, any_value(e.period) AS period, any_value(e.split) AS split, any_value(e.ppi_len) AS ppi_len,
  coalesce(min(s.k) FILTER (s.k >= 3 AND {rej}), 31) AS kr, coalesce(min(s.k) FILTER (s.k >= 2 AND s.p_safe >= {theta}), 31) AS kc,
  coalesce(bool_or(s.k = {last} AND {rej}), FALSE) AS fr
  FROM (SELECT * FROM em WHERE {where}) e JOIN {src} s ON s.flow_id = e.flow_id AND s.k <= {last} {join} GROUP BY e.flow_id),
{name} AS MATERIALIZED (SELECT x.flow_id, x.label, x.period, x.split, x.ppi_len, x.k, x.decision,
   CASE WHEN x.decision IN (1, 3) THEN -1 ELSE s.pred END AS prediction, s.p_safe AS p_safe_at, s.surprise AS surprise_at
  FROM (SELECT *, CAST(CASE WHEN least(kr, kc) <= 30 THEN least(kr, kc) ELSE least(ppi_len, {cap}) END AS INTEGER) AS k,
     CASE WHEN least(kr, kc) <= 30 THEN CASE WHEN {wins} THEN 1 ELSE 0 END WHEN fr THEN 3 ELSE 2 END AS decision FROM {name}0) x
  JOIN {src} s ON s.flow_id = x.flow_id AND s.k = x.k)"""


SAFE_SQL = safe_sql()
ECHO_SQL = """de AS MATERIALIZED (SELECT x.flow_id, x.label, x.period, x.ppi_len, x.k, x.decision, s.pred AS prediction FROM (
  SELECT e.flow_id, any_value(e.label) AS label, any_value(e.period) AS period, any_value(e.ppi_len) AS ppi_len,
   CAST(coalesce(min(s.k) FILTER (s.conf >= 0.5::DOUBLE), any_value(e.ppi_len)) AS INTEGER) AS k,
   CASE WHEN bool_or(s.conf >= 0.5::DOUBLE) THEN 0 ELSE 2 END AS decision
  FROM (SELECT * FROM em WHERE split = 'test') e JOIN sc s ON s.flow_id = e.flow_id AND s.k <= e.ppi_len GROUP BY e.flow_id) x
 JOIN sc s ON s.flow_id = x.flow_id AND s.k = x.k)"""
DEC = "SELECT flow_id, label, period, ppi_len, k, decision, prediction FROM de"
COLS = ["flow_id", "label", "period", "ppi_len", "k", "decision", "prediction"]


def reject_theta(scores: DataFrame, f: float = 0.1) -> list[float | None]:
    return C.theta_array(C.reject_thresholds(scores.where("split = 'val'"), [f], digits=9), f)


def safe_decisions(spark: SparkSession, sf: str, order: str = "reject_first", theta: float = 0.5) -> DataFrame:
    s = em_scores(spark, sf)
    return H.safe_stop(s.where("split = 'test'"), theta, reject_theta(s), order=order, extra=["p_safe", "surprise"])


@query("safe_stop", Q.EM_SCORES + f", {Q.theta_sql(0.1)}, {SAFE_SQL} {DEC}")
def safe_stop(spark: SparkSession, sf: str) -> DataFrame:
    return safe_decisions(spark, sf).select(*COLS)


@query("safe_stop_commit_first", Q.EM_SCORES + f", {Q.theta_sql(0.1)}, {safe_sql(order='commit_first')} {DEC}")
def safe_stop_commit_first(spark: SparkSession, sf: str) -> DataFrame:
    return safe_decisions(spark, sf, "commit_first").select(*COLS)


@query("decide_per_prefix", Q.EM_SCORES + f", {Q.theta_sql(0.1)}, {SAFE_SQL} {DEC}")
def decide_per_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """The per-prefix rule on every (flow, k); the first prefix it answers on is the decision."""
    s = em_scores(spark, sf)
    theta = H.theta_column(reject_theta(s))
    rows = C.reached(C.long_scores(s.where("split = 'test'"), ["p_safe", "u", "pred"], ["flow_id", "label", "period", "ppi_len"]))
    d = H.decide(
        F.col("k"), F.col("p_safe"), F.col("u"), F.col("pred"), F.lit(0.5), F.element_at(theta, F.col("k")),
        F.least("ppi_len", F.lit(S.K_MAX)),
    )
    hit = rows.withColumn("d", d).where("d is not null")
    first = hit.groupBy("flow_id", "label", "period", "ppi_len").agg(F.min("k").alias("k"), F.min_by("d", "k").alias("d"))
    return first.select("flow_id", "label", "period", "ppi_len", "k", "d.decision", "d.prediction")


@query("confidence_stop", Q.EM_SCORED + f", {ECHO_SQL} {DEC}")
def confidence_stop(spark: SparkSession, sf: str) -> DataFrame:
    return H.confidence_stop(em_scored(spark, sf).where("split = 'test'"), 0.5).select(*COLS)


LASTP = """lp AS MATERIALIZED (SELECT flow_id, label, pred, conf, CASE WHEN pred = label THEN 1 ELSE 0 END AS ok FROM sc WHERE split = 'val' AND label >= 0 AND k = ppi_len)"""
PREC = """pg AS (SELECT conf, row_number() OVER w AS rn, sum(ok) OVER w AS h FROM lp WINDOW w AS (ORDER BY conf DESC, flow_id)),
pc2 AS (SELECT pred, conf, row_number() OVER w AS rn, sum(ok) OVER w AS h, count(*) OVER (PARTITION BY pred) AS n FROM lp WINDOW w AS (PARTITION BY pred ORDER BY conf DESC, flow_id))"""


def taus_sql(p: str = "0.3::DOUBLE", support: int = 5) -> str:
    return f"""gt AS (SELECT coalesce(arg_max(conf, rn) FILTER (h::DOUBLE / rn >= {p}), 1.0::DOUBLE) AS tau FROM pg),
ot AS (SELECT pred, coalesce(arg_max(conf, rn) FILTER (h::DOUBLE / rn >= {p}), 1.0::DOUBLE) AS tau FROM pc2 WHERE n >= {support} GROUP BY pred),
tc AS MATERIALIZED (SELECT CAST(c AS INTEGER) AS c, coalesce(ot.tau, gt.tau) AS tau FROM range(0, 8) r(c) CROSS JOIN gt LEFT JOIN ot ON ot.pred = c)"""


@query(
    "precision_threshold",
    Q.EM_SCORED + f", {LASTP}, {PREC}"
    + " SELECT p AS precision, round(coalesce(arg_max(conf, rn) FILTER (h::DOUBLE / rn >= p), 1.0::DOUBLE), 6) AS tau"
    " FROM pg CROSS JOIN (SELECT unnest([0.2::DOUBLE, 0.3::DOUBLE, 0.95::DOUBLE]) AS p) GROUP BY p",
)
def precision_threshold(spark: SparkSession, sf: str) -> DataFrame:
    rows = H.last_prefix(em_scored(spark, sf).where("split = 'val'"))
    out = H.precision_thresholds(rows, [0.2, 0.3, 0.95])
    return out.select("precision", F.round("tau", 6).alias("tau"))


@query("class_thresholds", Q.EM_SCORED + f", {LASTP}, {PREC}, {taus_sql()} SELECT c, round(tau, 6) AS tau FROM tc")
def class_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    t = H.class_thresholds(em_scored(spark, sf).where("split = 'val'"), [0.3], B.EM_CLASSES, 5)
    return t.select(F.posexplode("taus").alias("c", "tau")).select("c", F.round("tau", 6).alias("tau"))


@query(
    "class_threshold_stop",
    Q.EM_SCORED + f""", {LASTP}, {PREC}, {taus_sql()},
de0 AS (SELECT e.flow_id, any_value(e.label) AS label, any_value(e.period) AS period, any_value(e.ppi_len) AS ppi_len,
  coalesce(min(s.k) FILTER (s.conf >= tc.tau), 31) AS kh, max(s.energy_raw) FILTER (s.k = least(10, e.ppi_len)) AS en
  FROM (SELECT * FROM em WHERE split = 'test') e JOIN sc s ON s.flow_id = e.flow_id AND s.k <= e.ppi_len JOIN tc ON tc.c = s.pred GROUP BY e.flow_id),
de1 AS (SELECT *, kh > least(10, ppi_len) AND en >= 14.0::DOUBLE AS gated FROM de0),
de AS (SELECT x.*, CASE WHEN decision = 1 THEN -1 ELSE s.pred END AS prediction FROM (
  SELECT flow_id, label, period, ppi_len, CAST(CASE WHEN gated THEN least(10, ppi_len) WHEN kh <= 30 THEN kh ELSE ppi_len END AS INTEGER) AS k,
   CASE WHEN gated THEN 1 WHEN kh <= 30 THEN 0 ELSE 2 END AS decision FROM de1) x JOIN sc s ON s.flow_id = x.flow_id AND s.k = x.k) {DEC}""",
)
def class_threshold_stop(spark: SparkSession, sf: str) -> DataFrame:
    s = em_scored(spark, sf)
    taus = H.class_thresholds(s.where("split = 'val'"), [0.3], B.EM_CLASSES, 5).first()["taus"]
    return H.class_threshold_stop(s.where("split = 'test'"), taus, 14.0).select(*COLS)


RL = {"lam": 0.5, "n_bins": 5, "min_count": 3}


def rl_sql() -> str:
    """The backward induction, one step per CTE."""
    b, mc, lam = RL["n_bins"], RL["min_count"], RL["lam"]
    cell = lambda v: f"least(greatest(CAST(floor({v} * {b}.0::DOUBLE) AS INTEGER), 0), {b - 1})"
    out = [
        f"st AS MATERIALIZED (SELECT flow_id, label, split, ppi_len, period, k, pred, {cell('conf')} * {b} + {cell('margin')} AS b,"
        " CASE WHEN pred = label THEN 1.0::DOUBLE ELSE 0 END AS hit FROM sc)",
        "kn AS MATERIALIZED (SELECT * FROM st WHERE split = 'val' AND label >= 0 AND k <= ppi_len)",
        f"bb AS (SELECT CAST(unnest(range(0, {b * b})) AS INTEGER) AS b)",
    ]
    for k in range(30, 0, -1):
        out.append(
            f"c{k} AS MATERIALIZED (SELECT bb.b, CASE WHEN count(n.hit) >= {mc} THEN avg(n.hit) ELSE coalesce((SELECT avg(hit) FROM kn WHERE k = {k}), 0) END"
            f" - {lam}::DOUBLE * {k} / 30.0::DOUBLE AS qc FROM bb LEFT JOIN (SELECT * FROM kn WHERE k = {k}) n ON n.b = bb.b GROUP BY bb.b)"
        )
        if k == 30:
            out.append("q30 AS MATERIALIZED (SELECT b, qc, CAST(NULL AS DOUBLE) AS qn FROM c30)")
        else:
            nk = k + 1
            out.append(
                f"v{k} AS MATERIALIZED (SELECT a.b, CASE WHEN a.ppi_len = {nk} THEN q.qc ELSE greatest(q.qc, coalesce(q.qn, q.qc)) END AS v"
                f" FROM kn a JOIN kn n ON n.flow_id = a.flow_id AND n.k = {nk} JOIN q{nk} q ON q.b = n.b WHERE a.k = {k})"
            )
            out.append(
                f"q{k} AS MATERIALIZED (SELECT c{k}.b, any_value(c{k}.qc) AS qc, CASE WHEN count(v.v) >= {mc} THEN avg(v.v) ELSE (SELECT avg(v) FROM v{k}) END AS qn"
                f" FROM c{k} LEFT JOIN v{k} v ON v.b = c{k}.b GROUP BY c{k}.b)"
            )
    out.append("qq AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {k} AS k, b, qc, qn FROM q{k}" for k in range(1, 31)) + ")")
    return ",\n".join(out)


@query(
    "optimal_stop_fit",
    Q.EM_SCORED + f""", {rl_sql()} SELECT qq.k, qq.b AS bin, round(qc, 6) AS q_commit, round(qn, 6) AS q_cont
 FROM qq JOIN (SELECT DISTINCT k, b FROM kn) USING (k, b)""",
)
def optimal_stop_fit(spark: SparkSession, sf: str) -> DataFrame:
    val = em_scored(spark, sf).where("split = 'val'")
    q = H.fit_optimal_stop(val, [RL["lam"]], n_bins=RL["n_bins"], min_count=RL["min_count"])
    none = F.col("q_cont") == F.lit(float("-inf"))
    return q.where("bin >= 0").select(
        F.col("k").cast("int").alias("k"), F.col("bin").cast("int").alias("bin"), F.round("q_commit", 6).alias("q_commit"),
        F.when(~none, F.round("q_cont", 6)).alias("q_cont"),
    )


@query(
    "optimal_stop",
    Q.EM_SCORED + f""", {rl_sql()}, de0 AS (SELECT flow_id, min(st.k) AS k FROM st LEFT JOIN qq ON qq.k = st.k AND qq.b = st.b
 WHERE split = 'test' AND st.k <= ppi_len AND (st.k = ppi_len OR qn IS NULL OR qc >= qn) GROUP BY flow_id),
de AS (SELECT st.flow_id, label, period, ppi_len, st.k, CASE WHEN st.k < ppi_len THEN 0 ELSE 2 END AS decision, pred AS prediction
 FROM de0 JOIN st ON st.flow_id = de0.flow_id AND st.k = de0.k) {DEC}""",
)
def optimal_stop(spark: SparkSession, sf: str) -> DataFrame:
    s = em_scored(spark, sf)
    q = H.fit_optimal_stop(s.where("split = 'val'"), [RL["lam"]], n_bins=RL["n_bins"], min_count=RL["min_count"])
    return H.optimal_stop(s.where("split = 'test'"), q, n_bins=RL["n_bins"]).select(*COLS)


def sweep_points(spark: SparkSession, sf: str) -> DataFrame:
    grid = [0.05 * i for i in range(1, 20)]
    test = C.known_only(em_scored(spark, sf).where("split = 'test'"))
    return H.sweep(test, "conf", grid).select("theta", "mean_k", "accuracy")


GRID = H.logit_grid(12, 0.3, 0.95)
GRID_SQL = "[" + ", ".join(f"{g!r}::DOUBLE" for g in GRID) + "]"


@query(
    "threshold_sweep",
    Q.EM_SCORES + f""", {Q.theta_sql(0.1)}, tg AS (SELECT unnest({GRID_SQL}) AS theta),
d0 AS (SELECT tg.theta, e.flow_id, any_value(e.label) AS label, any_value(e.ppi_len) AS ppi_len,
  coalesce(min(s.k) FILTER (s.k >= 3 AND s.u >= th.theta), 31) AS kr, coalesce(min(s.k) FILTER (s.k >= 2 AND s.p_safe >= tg.theta), 31) AS kc,
  coalesce(bool_or(s.k = e.ppi_len AND s.u >= th.theta), FALSE) AS fr
  FROM tg CROSS JOIN (SELECT * FROM em WHERE split = 'test') e JOIN su s ON s.flow_id = e.flow_id AND s.k <= e.ppi_len LEFT JOIN th ON th.k = s.k GROUP BY tg.theta, e.flow_id),
d1 AS (SELECT *, CASE WHEN least(kr, kc) <= 30 THEN least(kr, kc) ELSE ppi_len END AS k, CASE WHEN least(kr, kc) <= 30 THEN CASE WHEN kr <= kc THEN 1 ELSE 0 END WHEN fr THEN 3 ELSE 2 END AS dec FROM d0),
d2 AS (SELECT d1.*, CASE WHEN dec IN (1, 3) THEN -1 ELSE s.pred END AS prediction FROM d1 JOIN su s ON s.flow_id = d1.flow_id AND s.k = d1.k)
SELECT round(theta, 6) AS theta, CAST(count(*) AS BIGINT) AS n, round(avg(k), 6) AS mean_k, round(quantile_cont(k, 0.95::DOUBLE), 6) AS p95_k,
 round(avg(CASE WHEN dec >= 2 THEN 1.0::DOUBLE ELSE 0 END), 6) AS forced_rate, round(avg(CASE WHEN prediction = label THEN 1.0::DOUBLE ELSE 0 END) FILTER (label >= 0), 6) AS accuracy,
 round(avg(CASE WHEN dec IN (1, 3) THEN 1.0::DOUBLE ELSE 0 END) FILTER (label >= 0), 6) AS known_reject_rate,
 round(avg(CASE WHEN dec IN (1, 3) THEN 1.0::DOUBLE ELSE 0 END) FILTER (label < 0), 6) AS unknown_reject_rate FROM d2 GROUP BY theta""",
)
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    s = em_scores(spark, sf)
    out = H.sweep(s.where("split = 'test'"), "p_safe", GRID, k_min=2, theta_reject=reject_theta(s))
    return out.select(*[c if c == "n" else F.round(c, 6).alias(c) for c in out.columns])


@query(
    "confidence_sweep",
    Q.EM_SCORED + """, tg AS (SELECT CAST(unnest(range(1, 20)) AS DOUBLE) * 0.05::DOUBLE AS theta),
dq AS (SELECT tg.theta, f.flow_id, f.label, coalesce(min(s.k) FILTER (s.conf >= tg.theta), f.ppi_len) AS k
  FROM tg CROSS JOIN (SELECT * FROM em WHERE split = 'test' AND label >= 0) f JOIN sc s ON s.flow_id = f.flow_id AND s.k <= f.ppi_len GROUP BY tg.theta, f.flow_id, f.label, f.ppi_len),
pt AS (SELECT theta, avg(dq.k) AS mean_k, avg(CASE WHEN sc.pred = dq.label THEN 1.0::DOUBLE ELSE 0 END) AS accuracy
  FROM dq JOIN sc ON sc.flow_id = dq.flow_id AND sc.k = dq.k GROUP BY theta)
SELECT round(theta, 6) AS theta, round(mean_k, 6) AS mean_k, round(accuracy, 6) AS accuracy FROM pt""",
)
def confidence_sweep(spark: SparkSession, sf: str) -> DataFrame:
    p = sweep_points(spark, sf)
    return p.select(*[F.round(c, 6).alias(c) for c in p.columns])


SUMMARY = """SELECT CAST(count(*) AS BIGINT) AS n, round(avg(k), 6) AS mean_k, round(quantile_cont(k, 0.95::DOUBLE), 6) AS p95_k,
 round(avg(CASE WHEN decision >= 2 THEN 1.0::DOUBLE ELSE 0 END), 6) AS forced_rate,
 round(avg(CASE WHEN prediction = label THEN 1.0::DOUBLE ELSE 0 END) FILTER (label >= 0), 6) AS known_accuracy,
 round(avg(CASE WHEN decision IN (1,3) THEN 1.0::DOUBLE ELSE 0 END) FILTER (label >= 0), 6) AS known_reject_rate,
 round(avg(k) FILTER (label >= 0), 6) AS mean_k_known,
 round(avg(CASE WHEN decision IN (1,3) THEN 1.0::DOUBLE ELSE 0 END) FILTER (label < 0), 6) AS unknown_reject_rate,
 round(1.0::DOUBLE - avg(CASE WHEN decision IN (1,3) THEN 1.0::DOUBLE ELSE 0 END) FILTER (label < 0), 6) AS unknown_committed,
 round(avg(k) FILTER (label < 0), 6) AS mean_k_unknown, round(avg(k) FILTER (label < 0 AND decision IN (1,3)), 6) AS rejection_k"""


def open_f1_sql(src: str) -> str:
    """Macro-F1 over the classes among the labels of ``src``, the unknown one included."""
    return f"""(SELECT round(avg(CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (predicted + support) ELSE 0 END), 6) FROM (
  SELECT c, (SELECT count(*) FROM {src} WHERE label = c AND prediction IN (SELECT label FROM {src})) AS support,
   (SELECT count(*) FROM {src} WHERE prediction = c) AS predicted, (SELECT count(*) FROM {src} WHERE label = c AND prediction = c) AS tp
  FROM (SELECT DISTINCT label AS c FROM {src})) WHERE support > 0) AS open_set_macro_f1"""


@query("policy_summary", Q.EM_SCORES + f", {Q.theta_sql(0.1)}, {SAFE_SQL} {SUMMARY}, {open_f1_sql('de')} FROM de")
def policy_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = H.policy_summary(safe_decisions(spark, sf))
    return out.select(*[c if c == "n" else F.round(c, 6).alias(c) for c in out.columns])


# --- matched thresholds, fronts, open set ----------------------------------------------------------


def theta_fit_sql(target: float, where: str, src: str = "sc", name: str = "tf") -> str:
    """Bisection in the logit for the threshold with the target mean K, as a recursive CTE."""
    lo, hi = H.logit(0.5), H.logit(0.999)

    def mean(theta: str) -> str:
        return f"((SELECT base FROM {name}n) + coalesce((SELECT sum(w) FROM {name}b WHERE x < {theta}), 0)) / (SELECT n FROM {name}n)"

    theta = "1.0::DOUBLE / (1.0::DOUBLE + exp(-0.5::DOUBLE * (lo + hi)))"
    return f"""{name}r AS MATERIALIZED (SELECT s.flow_id, s.k, s.p_safe AS p, least(e.ppi_len, 30) AS last,
   max(s.p_safe) OVER (PARTITION BY s.flow_id ORDER BY s.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM {src} s JOIN (SELECT flow_id, ppi_len FROM em WHERE {where}) e ON e.flow_id = s.flow_id WHERE s.k >= 2 AND s.k <= least(e.ppi_len, 30)),
{name}s AS MATERIALIZED (SELECT flow_id, k, p, last, lead(k) OVER (PARTITION BY flow_id ORDER BY k) AS nk FROM {name}r WHERE before IS NULL OR p > before),
{name}b AS MATERIALIZED (SELECT p AS x, CAST(sum(coalesce(nk, last) - k) AS DOUBLE) AS w FROM {name}s GROUP BY p),
{name}n AS MATERIALIZED (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(k0) AS DOUBLE) AS base FROM (SELECT flow_id, min(k) AS k0 FROM {name}s GROUP BY flow_id)),
{name}i AS (SELECT 0 AS i, {lo!r}::DOUBLE AS lo, {hi!r}::DOUBLE AS hi, FALSE AS done, CAST(NULL AS DOUBLE) AS theta, CAST(NULL AS DOUBLE) AS mk
  UNION ALL
  SELECT i + 1, CASE WHEN NOT done AND abs(m - {target}) > 0.01 AND m < {target} THEN mid ELSE lo END,
   CASE WHEN NOT done AND abs(m - {target}) > 0.01 AND m >= {target} THEN mid ELSE hi END,
   done OR abs(m - {target}) <= 0.01, CASE WHEN done THEN theta ELSE t END, CASE WHEN done THEN mk ELSE m END
  FROM (SELECT *, {mean('t')} AS m FROM (SELECT *, 0.5::DOUBLE * (lo + hi) AS mid, {theta} AS t FROM {name}i WHERE i < 40))),
{name} AS MATERIALIZED (SELECT coalesce(max(theta) FILTER (done), max(1.0::DOUBLE / (1.0::DOUBLE + exp(-0.5::DOUBLE * (lo + hi)))) FILTER (NOT done)) AS theta, max(mk) AS mk
  FROM {name}i WHERE i = 40)"""


VAL_KNOWN = "split = 'val' AND label >= 0"


@query(
    "calibrate_threshold",
    Q.EM_SCORED + f", {theta_fit_sql(6.0, VAL_KNOWN)} SELECT round(theta, 6) AS theta, 1.0::DOUBLE AS reachable, round(mk, 6) AS mean_k FROM tf",
)
def calibrate_threshold(spark: SparkSession, sf: str) -> DataFrame:
    fit = H.calibrate_theta(C.known_only(em_scored(spark, sf).where("split = 'val'")), 6.0)
    row = (round(fit["theta"], 6), fit["reachable"], round(fit["mean_k"], 6))
    return spark.createDataFrame([row], "theta double, reachable double, mean_k double")


@query("operating_points")
def operating_points(spark: SparkSession, sf: str) -> DataFrame:
    from flowtide.operators import evaluate as V

    s = em_scored(spark, sf)
    d = V.operating_points(s.where("split = 'val'"), s.where("split = 'test'"), B.EM_CLASSES, 6.0, n=12, n_bins=5, min_count=3)
    return d.groupBy("policy", "knob", "val_mean_k").agg(F.count("*").alias("n"), F.avg("k").alias("mean_k"))


@query("policy_fronts")
def policy_fronts(spark: SparkSession, sf: str) -> DataFrame:
    from flowtide.operators import evaluate as V

    s = em_scored(spark, sf)
    return V.policy_fronts(s.where("split = 'val'"), s.where("split = 'test'"), B.EM_CLASSES, n=40, n_bins=5, min_count=3)


POINTS = """tg AS (SELECT CAST(unnest(range(1, 20)) AS DOUBLE) * 0.05::DOUBLE AS theta),
dq AS (SELECT tg.theta, f.flow_id, f.label, coalesce(min(s.k) FILTER (s.conf >= tg.theta), f.ppi_len) AS k
  FROM tg CROSS JOIN (SELECT * FROM em WHERE split = 'test' AND label >= 0) f JOIN sc s ON s.flow_id = f.flow_id AND s.k <= f.ppi_len GROUP BY tg.theta, f.flow_id, f.label, f.ppi_len),
pt AS (SELECT theta, avg(dq.k) AS mean_k, avg(CASE WHEN sc.pred = dq.label THEN 1.0::DOUBLE ELSE 0 END) AS accuracy
  FROM dq JOIN sc ON sc.flow_id = dq.flow_id AND sc.k = dq.k GROUP BY theta)"""


@query(
    "front_summary",
    Q.EM_SCORED + f""", {POINTS}, bb AS (SELECT 2.0::DOUBLE + 10.0::DOUBLE * i / 200 AS b FROM range(0, 201) r(i)),
ab AS (SELECT b, coalesce(max(accuracy) FILTER (mean_k <= b), 0) AS a FROM pt CROSS JOIN bb GROUP BY b)
SELECT 'confidence' AS policy, {", ".join(f"round(coalesce((SELECT max(accuracy) FROM pt WHERE mean_k <= {b}), 0), 6) AS acc_at_{b}" for b in (4, 6, 8))},
 round((SELECT avg(a) FROM ab), 6) AS pareto_area, round((SELECT min(mean_k) FROM pt), 6) AS smallest_mean_k""",
)
def front_summary(spark: SparkSession, sf: str) -> DataFrame:
    from flowtide.operators import evaluate as V

    out = V.front_summary(sweep_points(spark, sf).withColumn("policy", F.lit("confidence")))
    return out.select("policy", *[F.round(c, 6).alias(c) for c in out.columns if c != "policy"])


@query(
    "packets_for_accuracy",
    Q.EM_SCORED + f", {POINTS} SELECT t AS target, round(min(mean_k) FILTER (accuracy >= t), 6) AS mean_k FROM pt CROSS JOIN (SELECT unnest([0.2::DOUBLE, 0.99::DOUBLE]) AS t) GROUP BY t",
)
def packets_for_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    from flowtide.operators import evaluate as V

    pts = sweep_points(spark, sf)
    return C.concat([V.packets_for_accuracy(pts, t).select(F.lit(t).alias("target"), F.round("mean_k", 6).alias("mean_k")) for t in (0.2, 0.99)])


@query(
    "open_world",
    Q.EM_SCORES + f""", {theta_fit_sql(6.0, "split = 'val'")}, {Q.theta_sql(0.02)}, {safe_sql('(SELECT theta FROM tf)', name='rf')}, {safe_sql('(SELECT theta FROM tf)', 'commit_first', name='cf')}
{SUMMARY}, {open_f1_sql('rf')}, 'reject_first' AS check_order, round((SELECT theta FROM tf), 6) AS theta_commit, 1.0::DOUBLE AS reachable, round((SELECT mk FROM tf), 6) AS val_mean_k FROM rf
UNION ALL {SUMMARY}, {open_f1_sql('cf')}, 'commit_first', round((SELECT theta FROM tf), 6), 1.0::DOUBLE, round((SELECT mk FROM tf), 6) FROM cf""",
)
def open_world(spark: SparkSession, sf: str) -> DataFrame:
    from flowtide.operators import evaluate as V

    s = em_scores(spark, sf)
    out = V.open_world(s.where("split = 'val'"), s.where("split = 'test'"), digits=9)
    return out.select(*[c if c in ("n", "check_order", "reachable") else F.round(c, 6).alias(c) for c in out.columns])


SIG = ("energy_raw", "energy", "mahal", "surprise", "u", "z_energy")


@query(
    "unknown_auroc",
    Q.EM_SCORES + f""", t AS ({" UNION ALL ".join(f"SELECT '{s}' AS signal, k, label < 0 AS y, {s} AS v FROM su WHERE split = 'test' AND k <= ppi_len AND k IN (3, 5, 8, 10, 15, 30)" for s in SIG)}),
r AS (SELECT signal, k, y, rank() OVER (PARTITION BY signal, k ORDER BY v) + (count(*) OVER (PARTITION BY signal, k, v) - 1) / 2.0::DOUBLE AS rk FROM t),
g AS (SELECT signal, k, sum(rk) FILTER (y) AS s, CAST(count(*) FILTER (y) AS BIGINT) AS n_pos, CAST(count(*) FILTER (NOT y) AS BIGINT) AS n_neg FROM r GROUP BY 1, 2)
SELECT signal, k, round((s - n_pos * (n_pos + 1) / 2.0::DOUBLE) / (n_pos * n_neg), 6) AS auroc, n_pos, n_neg FROM g WHERE n_pos > 0 AND n_neg > 0""",
)
def unknown_auroc(spark: SparkSession, sf: str) -> DataFrame:
    from flowtide.operators import evaluate as V

    return V.unknown_auroc(em_scores(spark, sf).where("split = 'test'")).withColumn("auroc", F.round("auroc", 6))


@query(
    "rejection_stats",
    Q.EM_SCORES + f""", {Q.theta_sql(0.1)}, r AS (SELECT e.flow_id, any_value(e.label) AS label, min(s.k) FILTER (s.k >= 3 AND s.u >= th.theta) AS rk
 FROM (SELECT * FROM em WHERE split = 'test') e JOIN su s ON s.flow_id = e.flow_id AND s.k <= e.ppi_len LEFT JOIN th ON th.k = s.k GROUP BY e.flow_id)
SELECT 0.1::DOUBLE AS f, round(avg(CASE WHEN rk IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) FILTER (label >= 0), 6) AS known_reject_rate,
 round(avg(CASE WHEN rk IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) FILTER (label < 0), 6) AS unknown_reject_rate, round(avg(rk) FILTER (label < 0), 6) AS mean_rejection_k FROM r""",
)
def rejection_stats(spark: SparkSession, sf: str) -> DataFrame:
    from flowtide.operators import evaluate as V

    s = em_scores(spark, sf)
    out = V.rejection_stats(s.where("split = 'test'"), reject_theta(s), 0.1)
    return out.select("f", *[F.round(c, 6).alias(c) for c in out.columns if c != "f"])


@query(
    "energy_gate_stats",
    Q.EM_SCORED + """, g AS (SELECT round(quantile_cont(energy_raw, 0.9::DOUBLE), 9) AS t FROM sc WHERE split = 'val' AND label >= 0 AND k = 10 AND ppi_len >= 10),
r AS (SELECT label, CASE WHEN ppi_len >= 10 AND energy_raw >= (SELECT t FROM g) THEN 1.0::DOUBLE ELSE 0 END AS hit FROM sc WHERE split = 'test' AND k = 10)
SELECT 0.1::DOUBLE AS f, round(avg(hit) FILTER (label >= 0), 6) AS known_reject_rate, round(avg(hit) FILTER (label < 0), 6) AS unknown_reject_rate,
 max(CASE WHEN label < 0 AND hit > 0 THEN 10.0::DOUBLE END) AS mean_rejection_k FROM r""",
)
def energy_gate_stats(spark: SparkSession, sf: str) -> DataFrame:
    from flowtide.operators import evaluate as V

    s = em_scored(spark, sf)
    t = C.reject_thresholds(s.where("split = 'val'"), [0.1], "energy_raw", 9).where("k = 10").first()["theta"]
    out = V.gate_stats(s.where("split = 'test'"), t, 10, 0.1)
    return out.select("f", F.round("known_reject_rate", 6).alias("known_reject_rate"), F.round("unknown_reject_rate", 6).alias("unknown_reject_rate"), "mean_rejection_k")


@query("match_rejection_rate")
def match_rejection_rate(spark: SparkSession, sf: str) -> DataFrame:
    """The f matched to three known rejection rates, and the rate it really gives."""
    from flowtide.operators import evaluate as V

    val = em_scores(spark, sf).where("split = 'val'")
    bank = V.quantile_bank(val)
    parts = []
    for rate in (0.05, 0.2, 0.4):
        f = V.match_f(val, bank, rate)
        parts.append(V.rejection_stats(val, V.theta_at(bank, f), f).withColumn("target", F.lit(rate)))
    return C.concat(parts)


@query("earliness_report")
def earliness_report(spark: SparkSession, sf: str) -> DataFrame:
    from flowtide.operators import evaluate as V

    s = em_scores(spark, sf)
    return V.earliness_report(s.where("split = 'val'"), s.where("split = 'test'"), fs=(0.1, 0.2))


COST_SQL = """pk3 AS (SELECT 'three' AS policy, flow_id, 3 AS k, 0 AS prediction FROM fl UNION ALL SELECT 'eight', flow_id, 8, 1 FROM fl UNION ALL SELECT 'half', flow_id, greatest(ppi_len // 2, 1), 2 FROM fl),
cst AS (SELECT d.policy, least(d.k, f.ppi_len) AS k, CASE WHEN d.prediction = f.label THEN 1.0::DOUBLE ELSE 0 END AS hit,
  CAST(sum(pp.ipt) FILTER (pp.j <= least(d.k, f.ppi_len)) AS DOUBLE) AS t, CAST(sum(pp.ipt) AS DOUBLE) AS full_t
 FROM pk3 d JOIN fl f ON f.flow_id = d.flow_id JOIN pp ON pp.flow_id = d.flow_id GROUP BY d.policy, d.flow_id, d.k, f.ppi_len, d.prediction, f.label)"""


def _cost_decisions(spark: SparkSession, sf: str) -> DataFrame:
    from flowtide.plans.inputs import ev_long_flows

    fl = ev_long_flows(spark, sf).where("ppi_len > 0").select("flow_id", "label", "ppi", "ppi_len")
    rules = F.array(
        F.struct(F.lit("three").alias("policy"), F.lit(3).alias("k"), F.lit(0).alias("prediction")),
        F.struct(F.lit("eight").alias("policy"), F.lit(8).alias("k"), F.lit(1).alias("prediction")),
        F.struct(F.lit("half").alias("policy"), F.greatest(F.floor(F.col("ppi_len") / 2).cast("int"), F.lit(1)).alias("k"), F.lit(2).alias("prediction")),
    )
    rows = fl.select("flow_id", "label", "ppi", "ppi_len", F.explode(rules).alias("r"))
    return rows.select("flow_id", "label", "ppi", "ppi_len", "r.policy", F.least("r.k", "ppi_len").alias("k"), "r.prediction")


@query(
    "time_to_decision",
    Q.flows_sql(B.EV30_TIMEOUTS, rst=False) + """ SELECT f.flow_id, f.ppi_len, CAST(coalesce(sum(pp.ipt) FILTER (pp.j <= least(8, f.ppi_len)), 0) AS BIGINT) AS t FROM fl f JOIN pp ON pp.flow_id = f.flow_id GROUP BY f.flow_id, f.ppi_len""",
)
def time_to_decision(spark: SparkSession, sf: str) -> DataFrame:
    from flowtide.operators import evaluate as V
    from flowtide.plans.inputs import ev_long_flows

    fl = ev_long_flows(spark, sf).where("ppi_len > 0")
    return fl.select("flow_id", "ppi_len", V.time_to_decision(F.col("ppi"), F.lit(8), F.col("ppi_len")).alias("t"))


@query(
    "policy_cost",
    Q.flows_sql(B.EV30_TIMEOUTS, rst=False) + f""", {COST_SQL} SELECT policy, CAST(count(*) AS BIGINT) AS n, round(avg(k), 6) AS packets_mean, round(quantile_cont(k, 0.5::DOUBLE), 6) AS packets_median,
 round(quantile_cont(k, 0.95::DOUBLE), 6) AS packets_p95, round(avg(t), 6) AS time_mean, round(avg(t) / greatest(avg(full_t), 1e-9), 6) AS time_share, round(avg(hit), 6) AS accuracy,
 round(quantile_cont(t, 0.5::DOUBLE), 6) AS time_median, round(quantile_cont(t, 0.95::DOUBLE), 6) AS time_p95 FROM cst GROUP BY policy""",
)
def policy_cost(spark: SparkSession, sf: str) -> DataFrame:
    from flowtide.operators import evaluate as V

    out = V.policy_cost(_cost_decisions(spark, sf))
    return out.select("policy", "n", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("policy", "n")])
