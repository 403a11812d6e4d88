"""Queries over splits, leakage rules, sampling and label spaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide import bindings as B
from flowtide.functions import draws as R
from flowtide.operators import splits as P
from flowtide.plans import sql as Q
from flowtide.plans.inputs import ev_flows
from flowtide.plans.registry import query

FL = Q.flows_sql()
SPEC = {
    "train": {"periods": ["WEEK-2024-01", "WEEK-2024-02"]},
    "val": {"periods": ["WEEK-2024-03"]},
    "test_id": {"periods": ["WEEK-2024-04"], "session_ids": list(range(0, 15))},
    "test_drift": {"periods": ["WEEK-2024-05"]},
}
SP = """CASE WHEN period IN ('WEEK-2024-01','WEEK-2024-02') THEN 'train' WHEN period = 'WEEK-2024-03' THEN 'val'
 WHEN period = 'WEEK-2024-04' AND session_id < 15 THEN 'test_id' WHEN period = 'WEEK-2024-05' THEN 'test_drift' END"""
SPLIT_CTE = f"sp AS MATERIALIZED (SELECT *, {SP} AS split FROM fl WHERE {SP} IS NOT NULL)"


def ev_split(spark: SparkSession, sf: str) -> DataFrame:
    return P.assign(ev_flows(spark, sf), P.split_table(spark, SPEC))


@query("split_load", FL + f", {SPLIT_CTE} SELECT flow_id, split FROM sp")
def split_load(spark: SparkSession, sf: str) -> DataFrame:
    return ev_split(spark, sf).select("flow_id", "split")


BAD_SPLITS = """sl AS (SELECT DISTINCT CASE WHEN user_id % 3 = 0 THEN 'train' ELSE 'val' END AS split, user_id % 8 AS session_id,
 'D' || CAST(extract('day' FROM ts) // 4 AS VARCHAR) AS period FROM events)"""


@query(
    "split_overlap",
    f"""WITH {BAD_SPLITS} SELECT period, CAST(session_id AS INTEGER) AS session_id, 'session' AS problem FROM sl GROUP BY 1, 2 HAVING count(DISTINCT split) > 1""",
)
def split_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Claims read off the events: which (period, session) pairs two splits share."""
    e = B.table(spark, sf, "events")
    claims = e.select(
        F.when(F.col("user_id") % 3 == 0, F.lit("train")).otherwise(F.lit("val")).alias("split"),
        F.pmod("user_id", F.lit(8)).cast("int").alias("session_id"),
        F.concat(F.lit("D"), F.floor(F.day("ts") / 4).cast("string")).alias("period"),
    ).distinct()
    return P.overlap_problems(claims)


@query("split_standardizer_hash")
def split_standardizer_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Every split carries the hash of the training fit, and the check passes."""
    from flowtide.operators import features as X

    flows = ev_split(spark, sf).where("split = 'train'")
    fit = X.fit_continuous(flows).withColumn("view", F.lit("continuous"))
    names = P.split_table(spark, SPEC).select("split").distinct()
    table = names.crossJoin(F.broadcast(X.standardizer_hash(fit).select(F.col("hash").alias("standardizer_hash"))))
    P.assert_one_standardizer(table)
    return table


@query("split_sessions", FL + " SELECT flow_id FROM fl WHERE period = 'WEEK-2024-04' AND session_id IN (1, 4, 9)")
def split_sessions(spark: SparkSession, sf: str) -> DataFrame:
    ids = spark.createDataFrame([("WEEK-2024-04", s) for s in (1, 4, 9)], "period string, session_id int")
    return P.restrict_sessions(ev_flows(spark, sf), ids).select("flow_id")


def held_out(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(5,), (6,)], "label int")


@query("split_drop_held_out", FL + f", {SPLIT_CTE} SELECT flow_id, split, label FROM sp WHERE NOT (split = 'train' AND label IN (5, 6))")
def split_drop_held_out(spark: SparkSession, sf: str) -> DataFrame:
    return P.drop_held_out(ev_split(spark, sf), held_out(spark)).select("flow_id", "split", "label")


@query(
    "split_training_labels",
    FL + f", {SPLIT_CTE} SELECT label, CAST(count(*) AS BIGINT) AS n FROM sp WHERE split = 'train' AND label IN (5, 6) GROUP BY label",
)
def split_training_labels(spark: SparkSession, sf: str) -> DataFrame:
    return P.training_label_problems(ev_split(spark, sf), held_out(spark))


ORD = "CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 WHEN 'test_id' THEN 2 ELSE 3 END"
FLOOR = f"""o AS (SELECT *, end_us AS ts, {ORD} AS ord FROM sp), m AS (SELECT split, ord, max(ts) AS mx FROM o GROUP BY 1, 2),
fo AS (SELECT split, coalesce(max(mx) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS f FROM m)"""


@query("split_boundary_trim", FL + f", {SPLIT_CTE}, {FLOOR} SELECT flow_id, o.split FROM o JOIN fo ON fo.split = o.split WHERE ts > f")
def split_boundary_trim(spark: SparkSession, sf: str) -> DataFrame:
    return P.trim_boundaries(ev_split(spark, sf).withColumn("ts", F.col("end_us"))).select("flow_id", "split")


@query(
    "split_trim_counts",
    FL + f", {SPLIT_CTE}, {FLOOR} SELECT o.split, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (ts <= f) AS BIGINT) AS dropped FROM o JOIN fo ON fo.split = o.split GROUP BY o.split",
)
def split_trim_counts(spark: SparkSession, sf: str) -> DataFrame:
    return P.trim_counts(ev_split(spark, sf).withColumn("ts", F.col("end_us")))


@query(
    "split_temporal_order",
    FL + f", {SPLIT_CTE} SELECT split, CAST(min(start_us) AS BIGINT) AS first_ts, CAST(max(start_us) AS BIGINT) AS last_ts FROM sp GROUP BY split",
)
def split_temporal_order(spark: SparkSession, sf: str) -> DataFrame:
    flows = ev_split(spark, sf).withColumn("ts", F.col("start_us"))
    P.assert_temporal_order(flows)
    return P.time_ranges(flows)


PROFILE = """pf0 AS (SELECT CAST(flow_key AS INTEGER) AS label, category, count(*) AS n FROM fl WHERE period IN ('WEEK-2024-04', 'WEEK-2024-05') GROUP BY 1, 2),
pf AS MATERIALIZED (SELECT label, CAST(sum(n) AS BIGINT) AS support, arg_max(category, n * 100 - category) AS category FROM pf0 GROUP BY label)"""


def profile(spark: SparkSession, sf: str) -> DataFrame:
    """Users play the classes here, so there are enough of them to draw from."""
    flows = ev_flows(spark, sf).where(F.col("period").isin("WEEK-2024-04", "WEEK-2024-05"))
    return P.class_profile(flows.select(F.col("flow_key").cast("int").alias("label"), "category"))


@query("class_profile", FL + f", {PROFILE} SELECT label, support, category FROM pf")
def class_profile(spark: SparkSession, sf: str) -> DataFrame:
    return profile(spark, sf)


DRAW = lambda purpose: R.lcg_draw_sql(42, purpose, "CAST(label AS BIGINT)")


@query(
    "open_set_draw",
    FL + f""", {PROFILE}, b AS (SELECT *, {DRAW('open-set')} AS o, support >= 3 AS ok, (SELECT count(*) // 5 FROM pf) // (SELECT count(DISTINCT category) FROM pf)
   + CASE WHEN dense_rank() OVER (ORDER BY category) <= (SELECT count(*) // 5 FROM pf) % (SELECT count(DISTINCT category) FROM pf) THEN 1 ELSE 0 END AS quota FROM pf),
e AS (SELECT *, count(*) OVER (PARTITION BY category) // 2 AS half, row_number() OVER (PARTITION BY category ORDER BY support, label) AS r FROM b WHERE ok),
t AS (SELECT *, r <= half AS rare, CASE WHEN r <= half THEN least((quota + 1) // 2, half) ELSE quota - least((quota + 1) // 2, half) END AS take FROM e),
i AS (SELECT *, row_number() OVER (PARTITION BY category, rare ORDER BY o, label) <= take AS first FROM t),
u AS (SELECT label FROM i QUALIFY row_number() OVER (ORDER BY first DESC, o, label) <= (SELECT count(*) // 5 FROM pf)),
k AS (SELECT label FROM pf WHERE label NOT IN (SELECT label FROM u) QUALIFY row_number() OVER (ORDER BY {DRAW('open-set/known')}, label) <= (SELECT 3 * count(*) // 5 FROM pf))
SELECT label, 'unknown' AS role FROM u UNION ALL SELECT label, 'known' FROM k""",
)
def open_set_draw(spark: SparkSession, sf: str) -> DataFrame:
    """Three fifths of the classes known, one fifth unknown."""
    classes = profile(spark, sf)
    n = classes.count()
    return P.draw_open_set(classes, 3 * n // 5, n // 5, 3, R.arithmetic(42))


@query(
    "subsample_rows",
    f"SELECT o_orderkey FROM orders ORDER BY {R.lcg_draw_sql(3, 'subsample', 'o_orderkey')}, o_orderkey LIMIT 500",
)
def subsample_rows(spark: SparkSession, sf: str) -> DataFrame:
    orders = B.table(spark, sf, "orders").select("o_orderkey")
    return P.subsample(orders, 500, R.arithmetic(3), "o_orderkey")


@query(
    "label_fraction",
    f"SELECT event_id FROM events ORDER BY {R.lcg_draw_sql(3, 'subsample', 'event_id')}, event_id LIMIT (SELECT CAST(round(count(*) * 0.1::DOUBLE) AS BIGINT) FROM events)",
)
def label_fraction(spark: SparkSession, sf: str) -> DataFrame:
    return P.label_fraction(B.table(spark, sf, "events").select("event_id"), 0.1, R.arithmetic(3), "event_id")


@query("row_sample")
def row_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A sampled line item table, with the counts before and after."""
    rows = B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    kept = P.sample_rows(rows, 0.1, 11, F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"))
    return rows.agg(F.count("*").alias("n_before")).crossJoin(kept.agg(F.count("*").alias("n_after")))


def ev_space(spark: SparkSession) -> DataFrame:
    return P.label_space(spark, range(5), (5, 6), {c: f"app-{c}" for c in range(7)})


@query(
    "label_space_map",
    FL + " SELECT flow_id, label, CASE WHEN label < 5 THEN label ELSE -1 END AS model_idx, CASE WHEN label < 5 THEN label ELSE -1 END AS dataset_id FROM fl",
)
def label_space_map(spark: SparkSession, sf: str) -> DataFrame:
    space = ev_space(spark)
    mapped = P.to_model(ev_flows(spark, sf), space).select("flow_id", "label", "model_idx")
    return P.to_dataset(mapped, space)


@query(
    "class_counts",
    FL + " SELECT CAST(c AS INTEGER) AS dataset_id, CAST(c AS INTEGER) AS model_idx, CAST((SELECT count(*) FROM fl WHERE label = c) AS BIGINT) AS n FROM range(0, 5) r(c)",
)
def class_counts(spark: SparkSession, sf: str) -> DataFrame:
    return P.class_counts(ev_flows(spark, sf), ev_space(spark))


@query(
    "balanced_weights",
    """WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), f AS (SELECT event_type, n, least(1.5::DOUBLE, avg(n) OVER () / n) AS f FROM c)
SELECT e.event_id, round(f.f / (SELECT sum(f * n) FROM f) * 1000000.0::DOUBLE, 6) AS weight FROM events e JOIN f USING (event_type)""",
)
def balanced_weights(spark: SparkSession, sf: str) -> DataFrame:
    w = P.balanced_weights(B.table(spark, sf, "events").select("event_id", "event_type"), 1.5, "event_type")
    return w.select("event_id", F.round(F.col("weight") * 1e6, 6).alias("weight"))


@query(
    "epoch_permutations",
    f"""WITH w AS (SELECT vec_id, p AS pass_no, {R.lcg_draw_sql(5, 'epoch', 'vec_id * 1009 + p')} AS d FROM embeddings, range(0, 2) r(p)),
 s AS (SELECT CAST(pass_no AS INTEGER) AS pass_no, CAST(row_number() OVER (ORDER BY pass_no, d, vec_id) AS BIGINT) AS slot, vec_id FROM w)
SELECT pass_no, slot, vec_id FROM s WHERE slot <= (SELECT 3 * count(*) // 2 FROM embeddings)""",
)
def epoch_permutations(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.table(spark, sf, "embeddings").select("vec_id")
    return P.epoch_permutations(rows, 3 * rows.count() // 2, R.arithmetic(5), "vec_id")


@query("weighted_draw")
def weighted_draw(spark: SparkSession, sf: str) -> DataFrame:
    """As many draws as rows, with replacement, by balanced weights: share of every class."""
    from flowtide.operators.budget import weighted_draw as draw

    rows = P.balanced_weights(B.em_flows(spark, sf).select(F.col("flow_id").alias("pos"), "class_id"), 10.0, "class_id")
    n = spark.range(rows.count()).withColumnRenamed("id", "draw")
    out = draw(rows, F.col("weight"), n, 1, "epoch")
    return out.groupBy("class_id").agg(F.count("*").alias("n"))


@query(
    "at_most_per_class",
    f"SELECT vec_id, CAST(label AS INTEGER) AS label FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY {R.lcg_draw_sql(9, 'per-group', 'vec_id')}, vec_id) <= 12",
)
def at_most_per_class(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"))
    return P.at_most_per_group(rows, "label", 12, R.arithmetic(9), "vec_id")


@query(
    "week_cap",
    FL + f" SELECT flow_id, period FROM fl QUALIFY row_number() OVER (PARTITION BY period ORDER BY {R.lcg_draw_sql(9, 'per-group', 'flow_id')}, flow_id) <= 100",
)
def week_cap(spark: SparkSession, sf: str) -> DataFrame:
    return P.at_most_per_group(ev_flows(spark, sf).select("flow_id", "period"), "period", 100, R.arithmetic(9), "flow_id")


@query(
    "replay_sample",
    FL + f" SELECT flow_id, 'app-' || label AS name, label < 5 AS known FROM fl WHERE period = 'WEEK-2024-04' ORDER BY {R.lcg_draw_sql(2, 'subsample', 'flow_id')}, flow_id LIMIT 80",
)
def replay_sample(spark: SparkSession, sf: str) -> DataFrame:
    return P.replay_sample(ev_flows(spark, sf), "WEEK-2024-04", 80, R.arithmetic(2), ev_space(spark)).select("flow_id", "name", "known")
