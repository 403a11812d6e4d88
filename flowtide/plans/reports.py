"""Queries over model comparison, runs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide import bindings as B
from flowtide import schema as S
from flowtide.operators import reports as R
from flowtide.operators import scores as C
from flowtide.plans import sql as Q
from flowtide.plans.calibration import ADJ, ADJ_SQL
from flowtide.plans.inputs import em_scored, em_scorer
from flowtide.plans.registry import query
from flowtide.session import scratch_path

KS = [1, 3, 5, 8, 30]


def two_models(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    import numpy as np

    flows = B.em_flows(spark, sf)
    scorer = em_scorer(flows)
    test = flows.where("split = 'test'")
    a = C.score_flows(test, C.ScoreModel(scorer))
    b = C.score_flows(test, C.ScoreModel(scorer, adjustment=np.array(ADJ) * 10))
    return R.predictions(a, KS), R.predictions(b, KS)


B_SQL = Q.class_scores_sql(f"{ADJ_SQL} * 10.0::DOUBLE", name="cb")


@query(
    "paired_difference",
    Q.EM_SCORED + f""", {B_SQL}, d AS (SELECT sc.k, avg(CASE WHEN sc.pred = sc.label THEN 1.0::DOUBLE ELSE 0 END) AS a, avg(CASE WHEN cb.pred = sc.label THEN 1.0::DOUBLE ELSE 0 END) AS b
 FROM sc JOIN cb USING (flow_id, k) WHERE sc.split = 'test' AND sc.label >= 0 AND sc.k IN (1, 3, 5, 8, 30) GROUP BY sc.k)
SELECT k, round(a, 6) AS a, round(b, 6) AS b, round(b - a, 6) AS diff FROM d UNION ALL SELECT 0, round(avg(a), 6), round(avg(b), 6), round(avg(b) - avg(a), 6) FROM d""",
)
def paired_difference(spark: SparkSession, sf: str) -> DataFrame:
    a, b = two_models(spark, sf)
    out = R.observed(R.patterns(R.paired(a, b)), KS)
    return out.select("k", *[F.round(c, 6).alias(c) for c in ("a", "b", "diff")])


@query("paired_bootstrap")
def paired_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    a, b = two_models(spark, sf)
    return R.paired_bootstrap(a, b, KS, n=500)


@query(
    "compact_predictions",
    Q.EM_SCORED + " SELECT flow_id, k, pred, pred = label AS correct FROM sc WHERE split = 'test' AND label >= 0 AND k IN (1, 3, 5, 8, 30)",
)
def compact_predictions(spark: SparkSession, sf: str) -> DataFrame:
    p = R.predictions(C.known_only(em_scored(spark, sf).where("split = 'test'")), KS)
    rows = p.select("flow_id", "label", F.explode(F.arrays_zip("ks", "preds")).alias("e"))
    return rows.select("flow_id", F.col("e.ks").alias("k"), F.col("e.preds").alias("pred"), (F.col("e.preds") == F.col("label")).alias("correct"))


# --- runs: orders of one priority and customer bucket play one training run ------------------------

RUNS_SQL = """rn AS (SELECT 'train-' || replace(lower(replace(o_orderpriority, ' ', '')), '-', '_') || '-main-s' || CAST(o_custkey % 4 AS VARCHAR) AS run_name, o_custkey % 4 AS run_seed,
 'train-' || replace(lower(replace(o_orderpriority, ' ', '')), '-', '_') || '-main' AS run_group, o_orderpriority AS config_hash, avg(o_totalprice) AS value FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    o = B.table(spark, sf, "orders")
    group = F.concat(F.lit("train-"), F.replace(F.lower(F.replace("o_orderpriority", F.lit(" "), F.lit(""))), F.lit("-"), F.lit("_")), F.lit("-main"))
    rows = o.select(
        F.concat(group, F.lit("-s"), (F.col("o_custkey") % 4).cast("string")).alias("run_name"),
        F.when(F.col("o_orderstatus") == "F", F.lit("FINISHED")).otherwise(F.lit("RUNNING")).alias("status"),
        F.lit(False).alias("git_dirty"), F.col("o_orderpriority").alias("config_hash"), F.lit("abc123").alias("git_commit"),
        F.lit("price").alias("metric"), F.col("o_totalprice").alias("value"),
    )
    return rows.groupBy("run_name", "status", "git_dirty", "config_hash", "git_commit", "metric").agg(F.avg("value").alias("value"))


@query(
    "run_groups",
    f"WITH {RUNS_SQL} SELECT run_name, 'train' AS stage, run_group, CAST(run_seed AS BIGINT) AS run_seed FROM rn",
)
def run_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.finished_runs(runs(spark, sf))
    R.assert_one_config(rows)
    return rows.select("run_name", "stage", "run_group", "run_seed")


@query(
    "run_group_table",
    f"WITH {RUNS_SQL} SELECT run_group, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, CAST(count(*) AS BIGINT) AS n, list_sort(list(CAST(run_seed AS BIGINT))) AS seeds FROM rn GROUP BY run_group",
)
def run_group_table(spark: SparkSession, sf: str) -> DataFrame:
    t = R.group_table(R.finished_runs(runs(spark, sf)))
    return t.select("run_group", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "n", "seeds")


@query("run_seed_interval")
def run_seed_interval(spark: SparkSession, sf: str) -> DataFrame:
    return R.seed_interval(R.finished_runs(runs(spark, sf)).select("run_group", "value"), ["run_group"], "value")


@query(
    "condition_deltas",
    """WITH c AS (SELECT l_linenumber AS run_group, CASE l_returnflag WHEN 'N' THEN 'clean' ELSE l_returnflag END AS condition, avg(l_quantity) AS value FROM lineitem GROUP BY ALL)
SELECT c.run_group, c.condition, round(c.value, 6) AS value, round(c.value - k.value, 6) AS delta FROM c JOIN c k ON k.run_group = c.run_group AND k.condition = 'clean'""",
)
def condition_deltas(spark: SparkSession, sf: str) -> DataFrame:
    li = B.table(spark, sf, "lineitem").select("l_linenumber", "l_returnflag", "l_quantity")
    rows = li.groupBy(
        F.col("l_linenumber").alias("run_group"),
        F.when(F.col("l_returnflag") == "N", F.lit("clean")).otherwise(F.col("l_returnflag")).alias("condition"),
    ).agg(F.avg("l_quantity").alias("value"))
    out = R.condition_deltas(rows, ["run_group"])
    return out.select("run_group", "condition", F.round("value", 6).alias("value"), F.round("delta", 6).alias("delta"))


REPORT_SQL = f"""kn AS (SELECT * FROM sc WHERE split = 'test' AND label >= 0 AND k IN ({", ".join(map(str, S.K_GRID))})),
cv AS (SELECT k, avg(CASE WHEN pred = label THEN 1.0::DOUBLE ELSE 0 END) AS v FROM kn GROUP BY k)"""


@query(
    "evaluation_report",
    Q.EM_SCORED + f", {REPORT_SQL} SELECT 'accuracy' AS metric, k, round(v, 6) AS value FROM cv UNION ALL SELECT 'auc_k', 0, round(avg(v), 6) FROM cv"
    " UNION ALL SELECT 'k95', 0, CAST(min(k) AS DOUBLE) FROM cv WHERE v >= 0.95::DOUBLE * (SELECT v FROM cv WHERE k = 30)",
)
def evaluation_report(spark: SparkSession, sf: str) -> DataFrame:
    r = R.evaluation_report(em_scored(spark, sf).where("split = 'test'"))
    return r.where(F.col("metric").isin("accuracy", "auc_k", "k95")).withColumn("value", F.round("value", 6))


@query("evaluation_report_full")
def evaluation_report_full(spark: SparkSession, sf: str) -> DataFrame:
    return R.evaluation_report(em_scored(spark, sf).where("split = 'test'"))


@query("robustness_summary")
def robustness_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy and AUC of a scorer fitted on clean flows, under every damage condition."""
    from flowtide.operators import damage as G
    from flowtide.operators import metrics as M
    from flowtide.plans.damage import CONDS, damaged
    from flowtide.schema import K_GRID
    from flowtide.streaming.engine import feature_column

    rows = damaged(spark, sf).withColumn("x", feature_column(F.col("ppi")))
    model = C.ScoreModel(C.fit_centroids(rows.where("condition = 'clean'"), 7, 0.05))
    scored = C.score_flows(rows.select("flow_id", "label", "condition", "ppi_len", "x"), model)
    long = C.long_scores(scored, ["pred"], ["condition", "label"])
    acc = M.accuracy(long, ["condition", "k"]).select("condition", F.lit("accuracy").alias("metric"), "k", F.col("accuracy").alias("value"))
    auc = acc.where(F.col("k").isin(*K_GRID)).groupBy("condition").agg(F.avg("value").alias("value")).select("condition", F.lit("auc_k").alias("metric"), F.lit(0).alias("k"), "value")
    reports = acc.unionByName(auc)
    R.assert_same_conditions(reports, list(G.conditions(CONDS)), ["metric", "k"])
    return R.robustness(reports)


@query(
    "acceptance_checks",
    f"""{Q.EM_SCORED}, {REPORT_SQL} SELECT 'accuracy@8' AS name, round((SELECT v FROM cv WHERE k = 8), 6) AS value, 0.1::DOUBLE AS bar, CASE WHEN (SELECT v FROM cv WHERE k = 8) >= 0.1 THEN 'met' ELSE 'not met' END AS verdict
UNION ALL SELECT 'accuracy@30', round((SELECT v FROM cv WHERE k = 30), 6), 0.99::DOUBLE, CASE WHEN (SELECT v FROM cv WHERE k = 30) >= 0.99 THEN 'met' ELSE 'not met' END
UNION ALL SELECT 'accuracy@1', round((SELECT v FROM cv WHERE k = 1), 6), NULL, 'reported' UNION ALL SELECT 'accuracy@99', NULL, 0.5::DOUBLE, 'not measured'""",
)
def acceptance_checks(spark: SparkSession, sf: str) -> DataFrame:
    from flowtide.operators import metrics as M

    rows = C.long_scores(C.known_only(em_scored(spark, sf).where("split = 'test'")), ["pred"], ["label"])
    measured = M.accuracy(rows, ["k"]).select(F.concat(F.lit("accuracy@"), F.col("k").cast("string")).alias("name"), F.col("accuracy").alias("value"))
    criteria = spark.createDataFrame(
        [("accuracy@8", ">=", 0.1), ("accuracy@30", ">=", 0.99), ("accuracy@1", ">=", None), ("accuracy@99", ">=", 0.5)], "name string, op string, bar double"
    )
    return R.acceptance(measured, criteria).withColumn("value", F.round("value", 6))


@query(
    "report_files",
    "SELECT CAST(user_id % 5 AS INTEGER) AS seed, round(avg(value), 6) AS mean_value, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1",
)
def report_files(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON report per seed, written and read back by path."""
    e = B.table(spark, sf, "events").groupBy((F.col("user_id") % 5).alias("s")).agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    rows = e.select(
        F.to_json(F.struct(F.struct(F.round("m", 6).alias("mean")).alias("value"), "n")).alias("value"), F.concat(F.lit("report-seed"), "s").alias("file")
    )
    path = scratch_path(spark, "reports")
    rows.repartition("file").write.partitionBy("file").text(path)
    return R.read_reports(spark, f"{path}/*", {"mean_value": "$.value.mean", "n": "$.n"})


@query(
    "thin_fronts",
    """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS v FROM orders GROUP BY 1),
 r AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM d)
SELECT day, round(v, 2) AS v FROM r WHERE i = 0 OR floor(i * 44 / greatest(n - 1, 1)::DOUBLE) > floor((i - 1) * 44 / greatest(n - 1, 1)::DOUBLE)""",
)
def thin_fronts(spark: SparkSession, sf: str) -> DataFrame:
    o = B.table(spark, sf, "orders")
    points = o.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("v"))
    return R.thin(points, "day").select("day", F.round("v", 2).alias("v"))
