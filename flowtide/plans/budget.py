"""Queries over budget tracking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.operators import budget as U
from flowtide.operators import evaluate as V
from flowtide.operators import scores as C
from flowtide.plans import sql as Q
from flowtide.plans.inputs import em_scored, em_scores
from flowtide.plans.registry import query

PART_SQL = "CASE WHEN split = 'val' THEN 'val' WHEN period <= 2 THEN 'test_id' ELSE 'test_drift' END"
PART_NO = "CASE WHEN split = 'val' THEN 0 WHEN period <= 2 THEN 1 ELSE 2 END"
STREAM_SQL = f"""sm AS MATERIALIZED (SELECT flow_id, label, ppi_len, period, {PART_SQL} AS part,
  row_number() OVER (ORDER BY {PART_NO}, period, flow_id) - 1 AS pos FROM em WHERE split <> 'train')"""


def stream_parts(scores: DataFrame) -> list[tuple[str, DataFrame]]:
    test = scores.where("split = 'test'")
    return [
        ("val", scores.where("split = 'val'")),
        ("test_id", test.where("period <= 2")),
        ("test_drift", test.where("period > 2")),
    ]


@query("stream_order", Q.EM_LOGITS + f", {STREAM_SQL} SELECT flow_id, part, CAST(pos AS BIGINT) AS pos FROM sm")
def stream_order(spark: SparkSession, sf: str) -> DataFrame:
    from flowtide import bindings as B

    flows = B.em_flows(spark, sf).drop("x")
    return U.stream_order(stream_parts(flows)).select("flow_id", "part", "pos")


@query(
    "stream_spans",
    Q.EM_LOGITS + f", {STREAM_SQL} SELECT part, CAST(min(pos) AS BIGINT) AS start, CAST(max(pos) + 1 AS BIGINT) AS stop FROM sm GROUP BY part",
)
def stream_spans(spark: SparkSession, sf: str) -> DataFrame:
    from flowtide import bindings as B

    return U.spans(U.stream_order(stream_parts(B.em_flows(spark, sf).drop("x"))))


@query(
    "hard_classes",
    Q.EM_SCORED + """, a AS (SELECT label, avg(CASE WHEN pred = label THEN 1.0::DOUBLE ELSE 0 END) AS accuracy, CAST(count(*) AS BIGINT) AS n FROM sc
 WHERE split = 'val' AND label >= 0 AND k = 5 AND ppi_len >= 5 GROUP BY label HAVING count(*) >= 3)
SELECT label, round(accuracy, 6) AS accuracy, n FROM a WHERE accuracy <= (SELECT quantile_cont(accuracy, 0.25::DOUBLE) FROM a)""",
)
def hard_classes(spark: SparkSession, sf: str) -> DataFrame:
    out = U.hard_classes(em_scored(spark, sf).where("split = 'val'"), min_flows=3)
    return out.withColumn("accuracy", F.round("accuracy", 6))


@query("stress_streams")
def stress_streams(spark: SparkSession, sf: str) -> DataFrame:
    """Both stress transforms: share of hard classes and of unknown flows before and after."""
    s = em_scored(spark, sf).select("flow_id", "label", "ppi_len", "period", "split", "pred")
    stream = U.stream_order(stream_parts(s))
    hard = U.hard_classes(s.where("split = 'val'"), min_flows=3)
    n = stream.count()
    lo, hi = n // 2, n

    def shares(df: DataFrame, name: str) -> DataFrame:
        seg = df.where((F.col("pos") >= lo) & (F.col("pos") < hi))
        marked = seg.join(F.broadcast(hard.select("label", F.lit(1.0).alias("h"))), "label", "left")
        return marked.agg(
            F.lit(name).alias("stream"), F.count("*").alias("n"), F.count_distinct("pos").alias("positions"),
            F.avg(F.coalesce("h", F.lit(0.0))).alias("hard_share"),
            F.avg((F.col("label") < 0).cast("double")).alias("unknown_share"),
        )

    return C.concat(
        [
            shares(stream, "as is"),
            shares(U.double_hard(stream, hard, lo, hi, 0), "hard classes doubled"),
            shares(U.unknown_burst(stream, 0.5, lo, hi, 0), "unknown burst"),
        ]
    )


@query(
    "count_windows",
    Q.EM_LOGITS + f""", {STREAM_SQL}, n AS (SELECT count(*) AS n FROM sm)
SELECT CAST(pos // 30 AS BIGINT) AS window_id, CAST(count(*) AS BIGINT) AS n, CAST(min(pos) AS BIGINT) AS start FROM sm, n WHERE n.n - (pos // 30) * 30 >= 15 GROUP BY 1""",
)
def count_windows(spark: SparkSession, sf: str) -> DataFrame:
    from flowtide import bindings as B

    rows = U.count_windows(U.stream_order(stream_parts(B.em_flows(spark, sf).drop("x"))), 30, drop_ragged=True)
    return rows.groupBy("window_id").agg(F.count("*").alias("n"), F.min("pos").alias("start"))


LOOP = {"window": 20, "kp": 0.5, "ki": 0.05, "theta": 0.6, "target": 6.0, "f": 0.1}
STEP_AT, STEP_TO = 4, 4.0


def replay_sql() -> str:
    """The feedback loop as a recursive CTE over per-window response tables."""
    w, kp, ki, th0 = LOOP["window"], LOOP["kp"], LOOP["ki"], LOOP["theta"]
    target = f"(CASE WHEN w >= {STEP_AT} THEN {STEP_TO}::DOUBLE ELSE {LOOP['target']}::DOUBLE END)"
    return f"""{STREAM_SQL}, {Q.theta_sql(LOOP['f'])},
rj AS MATERIALIZED (SELECT m.flow_id, m.pos // {w} AS w, least(m.ppi_len, 30) AS last, coalesce(min(s.k) FILTER (s.k >= 3 AND s.k <= m.ppi_len AND s.u >= th.theta), 31) AS kr
  FROM sm m JOIN su s ON s.flow_id = m.flow_id LEFT JOIN th ON th.k = s.k GROUP BY m.flow_id, m.pos, m.ppi_len),
rc0 AS (SELECT r.*, s.k, s.p_safe AS p, max(s.p_safe) OVER (PARTITION BY r.flow_id ORDER BY s.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM rj r JOIN su s ON s.flow_id = r.flow_id AND s.k >= 2 AND s.k <= least(CASE WHEN kr <= 30 THEN kr - 1 ELSE last END, last)),
rc AS MATERIALIZED (SELECT *, lead(k) OVER (PARTITION BY flow_id ORDER BY k) AS nk, CASE WHEN kr <= 30 THEN kr ELSE last END AS stop FROM rc0 WHERE before IS NULL OR p > before),
rb AS MATERIALIZED (SELECT w, p AS x, CAST(sum(coalesce(nk, stop) - k) AS DOUBLE) AS d FROM rc GROUP BY w, p),
rn AS MATERIALIZED (SELECT r.w, count(*) AS n, CAST(sum(coalesce(f.k0, CASE WHEN kr <= 30 THEN kr ELSE last END)) AS DOUBLE) AS base
  FROM rj r LEFT JOIN (SELECT flow_id, min(k) AS k0 FROM rc GROUP BY flow_id) f ON f.flow_id = r.flow_id GROUP BY r.w),
lp AS (SELECT 0 AS w, {th0}::DOUBLE AS theta, 0.0::DOUBLE AS integ, {kp}::DOUBLE AS kp, {ki}::DOUBLE AS ki, CAST([] AS DOUBLE[]) AS rec
  UNION ALL
  SELECT w + 1, CASE WHEN n < 10 THEN theta ELSE least(greatest(raw, 0.5::DOUBLE), 0.999::DOUBLE) END, CASE WHEN n < 10 THEN integ ELSE i2 END,
   CASE WHEN osc THEN kp * 0.5::DOUBLE ELSE kp END, CASE WHEN osc THEN ki * 0.5::DOUBLE ELSE ki END, CASE WHEN osc THEN CAST([] AS DOUBLE[]) WHEN n < 10 THEN rec ELSE rec2 END
  FROM (SELECT *, n >= 10 AND len(rec2) = 6 AND list_min(list_transform(rec2, lambda v: abs(v))) > 0.05
      AND rec2[1]*rec2[2] < 0 AND rec2[2]*rec2[3] < 0 AND rec2[3]*rec2[4] < 0 AND rec2[4]*rec2[5] < 0 AND rec2[5]*rec2[6] < 0 AS osc FROM
   (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(ln(theta / (1.0::DOUBLE - theta)) - (kp * e + ki * i2)))) AS raw, list_slice(list_append(CASE WHEN w = {STEP_AT} THEN CAST([] AS DOUBLE[]) ELSE rec END, e), -6, 99) AS rec2 FROM
    (SELECT *, least(greatest(integ + e, -1.0::DOUBLE), 1.0::DOUBLE) AS i2 FROM
     (SELECT *, (mk - {target}) / {target} AS e FROM
      (SELECT l.*, rn.n, (rn.base + coalesce((SELECT sum(d) FROM rb WHERE rb.w = l.w AND rb.x < l.theta), 0)) / rn.n AS mk FROM lp l JOIN rn ON rn.w = l.w)))))),
wr AS MATERIALIZED (SELECT l.w, l.theta, l.kp, rn.n, {target.replace('w >=', 'l.w >=')} AS target, (rn.base + coalesce((SELECT sum(d) FROM rb WHERE rb.w = l.w AND rb.x < l.theta), 0)) / rn.n AS mk FROM lp l JOIN rn ON rn.w = l.w)"""


def loop_windows(spark: SparkSession, sf: str, static: bool = False) -> DataFrame:
    s = em_scores(spark, sf)
    bank = V.quantile_bank(s.where("split = 'val'"))
    c = U.Loop(
        LOOP["target"], U.Dial(LOOP["theta"], 0.5, 0.999, LOOP["kp"], LOOP["ki"]), U.Dial(LOOP["f"], 0.001, 0.2, 0.2, 0.02),
        least_flows=10, targets={STEP_AT: STEP_TO}, held=static,
    )
    return U.replay(U.stream_order(stream_parts(s)), {"loop": c}, bank=bank, window=LOOP["window"])


@query(
    "windowed_replay",
    Q.EM_SCORES + f", {replay_sql()} SELECT CAST(w AS BIGINT) AS window_id, CAST(n AS BIGINT) AS n, target, round(theta, 6) AS theta, round(mk, 6) AS mean_k FROM wr",
)
def windowed_replay(spark: SparkSession, sf: str) -> DataFrame:
    return loop_windows(spark, sf).select("window_id", "n", "target", F.round("theta", 6).alias("theta"), F.round("mean_k", 6).alias("mean_k"))


@query(
    "tracking_summary",
    Q.EM_SCORES + f""", {replay_sql()}, x AS (SELECT w, abs((mk - target) / target) AS err, n >= 0.5 * max(n) OVER () AND w >= 2 AS ok FROM wr)
SELECT CAST(count(*) AS BIGINT) AS windows, round(avg(err) FILTER (ok), 6) AS mean_abs_error, round(max(err) FILTER (ok), 6) AS max_abs_error,
 round(avg(CASE WHEN err <= 0.2 THEN 1.0::DOUBLE ELSE 0 END) FILTER (ok), 6) AS within_tol FROM x""",
)
def tracking_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = U.tracking_summary(loop_windows(spark, sf), warmup=2, tol=0.2)
    return out.select("windows", *[F.round(c, 6).alias(c) for c in ("mean_abs_error", "max_abs_error", "within_tol")])


@query("tail_budget_replay")
def tail_budget_replay(spark: SparkSession, sf: str) -> DataFrame:
    """The p95 mode (moves k_cap) next to a loop that also caps the rejection rate (moves f)."""
    s = em_scores(spark, sf)
    bank = V.quantile_bank(s.where("split = 'val'"))
    dial = U.Dial(0.6, 0.5, 0.999, 0.5, 0.05)
    loops = {
        "p95": U.Loop(8.0, dial, follow="p95_k", least_flows=10),
        "reject_cap": U.Loop(6.0, dial, reject_limit=0.05, least_flows=10),
    }
    out = U.replay(U.stream_order(stream_parts(s)), loops, bank=bank, window=20)
    return out.select("name", "window_id", "theta", "k_cap", "f", "mean_k", "p95_k", "reject_rate", "reason")


@query("gain_selection")
def gain_selection(spark: SparkSession, sf: str) -> DataFrame:
    val = em_scores(spark, sf).where("split = 'val'")
    out = U.tune_gains(val, grid=[(0.5, 0.0), (0.5, 0.05), (3.0, 0.0)], bank=V.quantile_bank(val), f=0.1, window=10, min_flows=5)
    return out.select("kp", "ki", "qualified", "chosen", "mean_abs_error", "within_tol")


@query("controller_report")
def controller_report(spark: SparkSession, sf: str) -> DataFrame:
    s = em_scores(spark, sf)
    out = U.controller_report(
        stream_parts(s), budgets=(4.0, 6.0, 8.0), gains=(0.5, 0.05), bank=V.quantile_bank(s.where("split = 'val'")), f=0.1, window=50, min_flows=10
    )
    return out.select("case", "budget", "mode", "windows", "mean_abs_error", "within_tol")
