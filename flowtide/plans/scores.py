"""Queries over prefix scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide import bindings as B
from flowtide import schema as S
from flowtide.functions import draws as R
from flowtide.operators import scores as C
from flowtide.plans import sql as Q
from flowtide.plans.features import LONG, TOKENS_SQL
from flowtide.plans.inputs import em_bank, em_scored, em_scores, ev_long_flows
from flowtide.plans.registry import query


def em_logits(spark: SparkSession, sf: str) -> DataFrame:
    flows = B.em_flows(spark, sf)
    scorer = C.fit_centroids(flows.where("split = 'train'"), B.EM_CLASSES, B.EM_SCALE, digits=9)
    return C.score_logits(flows, scorer)


@query(
    "logits_effective",
    Q.EM_LOGITS + " SELECT flow_id, k, c, round(z, 6) AS z FROM ef WHERE k IN (1, 3, 8, 30)",
)
def logits_effective(spark: SparkSession, sf: str) -> DataFrame:
    return C.read_at(em_logits(spark, sf), [1, 3, 8, 30], B.EM_CLASSES).withColumn("z", F.round("z", 6))


@query("logits_nominal", Q.EM_LOGITS + " SELECT flow_id, k, c, round(z, 6) AS z FROM lg WHERE k IN (1, 3, 8, 30)")
def logits_nominal(spark: SparkSession, sf: str) -> DataFrame:
    return C.read_at(em_logits(spark, sf), [1, 3, 8, 30], B.EM_CLASSES, "nominal").withColumn("z", F.round("z", 6))


@query(
    "logits_from_outputs",
    Q.EM_LOGITS + " SELECT flow_id, k, c, round(z, 6) AS z, 'nominal' AS indexing FROM lg WHERE k IN (2, 5)",
)
def logits_from_outputs(spark: SparkSession, sf: str) -> DataFrame:
    z = em_logits(spark, sf)
    per_k = {k: C.read_at(z, [k], B.EM_CLASSES, "nominal").drop("k") for k in (2, 5)}
    return C.from_outputs(per_k, "nominal").withColumn("z", F.round("z", 6))


@query(
    "softmax_argmax",
    Q.EM_LOGITS + f""", {Q.class_scores_sql()} SELECT flow_id, k, pred, round(conf, 6) AS conf FROM cs""",
)
def softmax_argmax(spark: SparkSession, sf: str) -> DataFrame:
    s = C.class_scores(em_logits(spark, sf), B.EM_CLASSES, digits=6)
    return C.long_scores(s, ["pred", "conf"], ["flow_id"]).withColumn("conf", F.round("conf", 6))


ADJ = [0.0, 0.1, -0.2, 0.3, 0.0, -0.1, 0.2, 0.0]
ADJ_SQL = "[" + ",".join(f"{a}::DOUBLE" for a in ADJ) + "][c+1]"


@query(
    "class_score_columns",
    Q.EM_LOGITS + f""", {Q.class_scores_sql(ADJ_SQL, "(0.5::DOUBLE + least(k, ppi_len) / 20.0::DOUBLE)")}
SELECT flow_id, k, pred, pred_raw, round(conf, 6) AS conf, round(margin, 6) AS margin, round(energy, 6) AS energy,
 round(energy_raw, 6) AS energy_raw FROM cs""",
)
def class_score_columns(spark: SparkSession, sf: str) -> DataFrame:
    temps = [0.5 + k / 20.0 for k in range(1, S.K_MAX + 1)]
    s = C.class_scores(em_logits(spark, sf), B.EM_CLASSES, ADJ, temps, digits=6)
    rows = C.long_scores(s, ["pred", "pred_raw", "conf", "margin", "energy", "energy_raw"], ["flow_id"])
    return rows.select(
        "flow_id", "k", "pred", "pred_raw",
        *[F.round(c, 6).alias(c) for c in ("conf", "margin", "energy", "energy_raw")],
    )


@query(
    "score_fill_forward",
    Q.EM_SCORED + " SELECT flow_id, k, pred, round(conf, 6) AS conf FROM sc WHERE k >= ppi_len",
)
def score_fill_forward(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.long_scores(em_scored(spark, sf), ["pred", "conf"], ["flow_id", "ppi_len"])
    return rows.where("k >= ppi_len").select("flow_id", "k", "pred", F.round("conf", 6).alias("conf"))


@query("running_surprise", Q.EM_SCORED + " SELECT flow_id, k, surprise FROM sc")
def running_surprise(spark: SparkSession, sf: str) -> DataFrame:
    """From a column of per-packet NLLs (here 1 - conf), in plain expressions."""
    s = em_scored(spark, sf).select(
        "flow_id", "ppi_len", F.transform("conf", lambda p: F.lit(1.0) - p).alias("nll")
    )
    s = s.select("flow_id", C.running_surprise(F.col("nll"), F.col("ppi_len"), 12).alias("surprise"))
    rows = C.long_scores(s, ["surprise"], ["flow_id"])
    return rows


def _channel_sql(c: str, v: int) -> str:
    return f"""
c_{c} AS MATERIALIZED (SELECT prev_{c} AS p, next_{c} AS x, count(*) AS n FROM pr JOIN fl USING (flow_id) WHERE flow_key % 2 = 0 GROUP BY 1, 2),
t_{c} AS MATERIALIZED (SELECT p, sum(n) AS t FROM c_{c} GROUP BY p),
h_{c} AS MATERIALIZED (SELECT p, any_value(t) AS t, (sum(-((n+1.0::DOUBLE)/(t+{v}))*ln((n+1.0::DOUBLE)/(t+{v})))
   - ({v}-count(*))*max((1.0::DOUBLE/(t+{v}))*ln(1.0::DOUBLE/(t+{v}))))/ln({v}.0::DOUBLE) AS h FROM c_{c} JOIN t_{c} USING (p) GROUP BY p)"""


@query(
    "next_packet_likelihood",
    LONG + f""", {TOKENS_SQL},
pr AS MATERIALIZED (SELECT a.flow_id, b.j, a.size_token AS prev_size, b.size_token AS next_size, a.ipt_token AS prev_ipt, b.ipt_token AS next_ipt,
  a.dir_token AS prev_dir, b.dir_token AS next_dir FROM tk a JOIN tk b ON a.flow_id = b.flow_id AND b.j = a.j + 1),
{",".join(_channel_sql(c, v) for c, v in C.CHANNEL_VOCAB.items())}
SELECT pr.flow_id, pr.j, round({" + ".join(f"-ln((coalesce(c_{c}.n, 0) + 1.0::DOUBLE) / (coalesce(h_{c}.t, 0) + {v}))" for c, v in C.CHANNEL_VOCAB.items())}, 6) AS nll,
 round(({" + ".join(f"coalesce(h_{c}.h, 1.0::DOUBLE)" for c in C.CHANNEL_VOCAB)}) / 3, 6) AS entropy
FROM pr {" ".join(f"LEFT JOIN c_{c} ON c_{c}.p = prev_{c} AND c_{c}.x = next_{c} LEFT JOIN h_{c} ON h_{c}.p = prev_{c}" for c in C.CHANNEL_VOCAB)}""",
)
def next_packet_likelihood(spark: SparkSession, sf: str) -> DataFrame:
    flows = ev_long_flows(spark, sf)
    counts = C.transition_counts(flows.where(F.pmod("flow_key", F.lit(2)) == 0))
    out = C.next_packet_scores(flows, counts)
    return out.select("flow_id", "j", F.round("nll", 6).alias("nll"), F.round("entropy", 6).alias("entropy"))


@query(
    "score_pass",
    Q.EM_SCORES + """ SELECT flow_id, label, split, ppi_len, k, pred, round(conf, 6) AS conf, round(p_safe, 6) AS p_safe,
 surprise, mahal FROM su""",
)
def score_pass(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.long_scores(
        em_scores(spark, sf), ["pred", "conf", "p_safe", "surprise", "mahal"],
        ["flow_id", "label", "split", "ppi_len"],
    )
    return rows.select(
        "flow_id", "label", "split", "ppi_len", "k", "pred",
        *[F.round(c, 6).alias(c) for c in ("conf", "p_safe")], "surprise", "mahal",
    )


@query(
    "score_concat_take",
    Q.EM_SCORED + """ SELECT split, CAST(count(DISTINCT flow_id) AS BIGINT) AS n_flows, CAST(count(*) AS BIGINT) AS n_rows FROM sc
 WHERE split IN ('val', 'test') AND label >= 0 GROUP BY split""",
)
def score_concat_take(spark: SparkSession, sf: str) -> DataFrame:
    s = em_scored(spark, sf)
    both = C.concat([s.where("split = 'val'"), s.where("split = 'test'")])
    return (
        C.long_scores(C.known_only(both), ["conf"], ["flow_id", "split"])
        .groupBy("split")
        .agg(F.count_distinct("flow_id").alias("n_flows"), F.count("*").alias("n_rows"))
    )


@query("score_content_hash")
def score_content_hash(spark: SparkSession, sf: str) -> DataFrame:
    s = em_scored(spark, sf)
    return C.content_hash(s.select("flow_id", "label", "conf", "margin")).unionByName(
        C.content_hash(s.repartition(7).select("flow_id", "label", "conf", "margin"))
    )


def _exact_sql(c: str) -> str:
    """A double as its exact text, as the operator writes it."""
    power = f"(floor(log2(abs({c})))::INT - (pow(2.0::DOUBLE, floor(log2(abs({c})))) > abs({c}))::INT + (pow(2.0::DOUBLE, floor(log2(abs({c}))) + 1) <= abs({c}))::INT)"
    whole = f"(abs({c}) * pow(2.0::DOUBLE, floor((52 - {power}) / 2)) * pow(2.0::DOUBLE, (52 - {power}) - floor((52 - {power}) / 2)))::BIGINT"
    return f"coalesce(CASE WHEN {c} = 0 THEN '0' ELSE (CASE WHEN {c} < 0 THEN '-' ELSE '' END) || {whole} || 'p' || {power} END, '-')"


@query(
    "table_content_hash",
    f"""WITH v AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice * (1 - l_discount) AS net, l_tax * l_extendedprice AS tax FROM lineitem),
 d AS (SELECT md5(concat_ws(',', coalesce(l_linenumber::VARCHAR, '-'), coalesce(l_orderkey::VARCHAR, '-'),
   coalesce(octet_length(l_returnflag::BLOB) || ':' || l_returnflag, '-'), {_exact_sql("net")}, {_exact_sql("tax")})) AS d FROM v)
SELECT count(*) AS n_rows, (sum(('0x' || substr(d, 1, 15))::BIGINT) % 1152921504606846976)::BIGINT AS hash_a,
 (sum(('0x' || substr(d, 16, 15))::BIGINT) % 1152921504606846976)::BIGINT AS hash_b FROM d""",
)
def table_content_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Two products per row, hashed to the last bit."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    net, tax = F.col("l_extendedprice") * (1 - F.col("l_discount")), F.col("l_tax") * F.col("l_extendedprice")
    return C.content_hash(rows.select("l_orderkey", "l_linenumber", "l_returnflag", net.alias("net"), tax.alias("tax")))


@query(
    "gaussian_sums",
    Q.EM_LOGITS + """, f AS MATERIALIZED (SELECT g.k, em.label, dv.flow_id, d, CASE WHEN d <= 2 * g.k THEN v ELSE 0 END AS v
  FROM em JOIN dv USING (flow_id) JOIN (SELECT CAST(unnest(range(1, 31)) AS INTEGER) AS k) g ON em.ppi_len >= g.k
  WHERE split = 'train' AND label >= 0 AND d <= 60)
SELECT k, label, 0 AS i, 0 AS j, round(count(*) / 60, 6)::DOUBLE AS v FROM f GROUP BY ALL
UNION ALL SELECT k, label, CAST(d AS INTEGER), 0, round(sum(v), 6) FROM f GROUP BY k, label, d
UNION ALL SELECT a.k, a.label, CAST(a.d AS INTEGER), CAST(b.d AS INTEGER), round(sum(a.v * b.v), 6)
  FROM f a JOIN f b ON a.flow_id = b.flow_id AND a.k = b.k AND a.d <= b.d GROUP BY a.k, a.label, a.d, b.d""",
)
def gaussian_sums(spark: SparkSession, sf: str) -> DataFrame:
    train = C.known_only(B.em_flows(spark, sf).where("split = 'train'"))
    return C.gaussian_sums(train, C.em_projection).select("k", "label", "i", "j", (F.round("v", 6) + 0.0).alias("v"))


@query(
    "class_validity",
    Q.EM_LOGITS + Q.EM_MAHAL + " SELECT k, c AS label, CAST(n AS BIGINT) AS n FROM vc",
)
def class_validity(spark: SparkSession, sf: str) -> DataFrame:
    return C.class_validity(C.known_only(B.em_flows(spark, sf).where("split = 'train'")), 10)


@query("gaussian_bank")
def gaussian_bank(spark: SparkSession, sf: str) -> DataFrame:
    """Mean distance per K and split under the full-covariance bank."""
    flows = C.add_mahal(B.em_flows(spark, sf), em_bank(spark, sf, diagonal=False))
    rows = C.long_scores(flows, ["mahal"], ["split", "label", "ppi_len"])
    return (
        C.reached(rows)
        .groupBy("split", "k", (F.col("label") >= 0).alias("known"))
        .agg(F.round(F.avg("mahal"), 6).alias("mean_mahal"), F.count("*").alias("n"))
    )


@query(
    "relative_mahalanobis",
    Q.EM_LOGITS + Q.EM_MAHAL + " SELECT flow_id, k, round(mahal, 6) AS mahal FROM mh",
)
def relative_mahalanobis(spark: SparkSession, sf: str) -> DataFrame:
    flows = C.add_mahal(B.em_flows(spark, sf), em_bank(spark, sf))
    return C.long_scores(flows, ["mahal"], ["flow_id"]).withColumn("mahal", F.round("mahal", 6))


@query(
    "signal_moments",
    Q.EM_SCORES + """ SELECT k, round(em, 6) AS energy_mean, round(es, 6) AS energy_std, round(mm, 6) AS mahal_mean,
 round(ms, 6) AS mahal_std, round(sm, 6) AS surprise_mean, round(ss, 6) AS surprise_std FROM zp""",
)
def signal_moments(spark: SparkSession, sf: str) -> DataFrame:
    m = C.signal_moments(em_scores(spark, sf).where("split = 'val'"))
    return m.select("k", *[F.round(c, 6).alias(c) for c in m.columns if c != "k"])


@query("combined_unknown_score", Q.EM_SCORES + " SELECT flow_id, k, u, z_energy FROM su")
def combined_unknown_score(spark: SparkSession, sf: str) -> DataFrame:
    return C.long_scores(em_scores(spark, sf), ["u", "z_energy"], ["flow_id"])


@query(
    "reject_thresholds",
    Q.EM_SCORES + f""", {Q.theta_sql(0.02, 'a')}, {Q.theta_sql(0.1, 'b')}
SELECT k, 0.02::DOUBLE AS f, round(theta, 6) AS theta FROM a UNION ALL SELECT k, 0.1::DOUBLE, round(theta, 6) FROM b""",
)
def reject_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    t = C.reject_thresholds(em_scores(spark, sf).where("split = 'val'"), [0.02, 0.1], digits=9)
    return t.withColumn("theta", F.round("theta", 6))


@query(
    "first_rejection",
    Q.EM_SCORES + f""", {Q.theta_sql(0.1)} SELECT em.flow_id, CAST(coalesce(min(su.k) FILTER (su.u >= th.theta AND su.k >= 3 AND su.k <= em.ppi_len), 0) AS INTEGER) AS rejection_k
FROM em JOIN su USING (flow_id) LEFT JOIN th ON th.k = su.k GROUP BY em.flow_id""",
)
def first_rejection(spark: SparkSession, sf: str) -> DataFrame:
    s = em_scores(spark, sf)
    theta = C.theta_array(C.reject_thresholds(s.where("split = 'val'"), [0.1], digits=9), 0.1)
    last = F.least("ppi_len", F.lit(S.K_MAX))
    return s.select("flow_id", C.first_rejection(F.col("u"), theta, last).alias("rejection_k"))


@query(
    "energy_gate_threshold",
    Q.EM_SCORED + """ SELECT k, round(quantile_cont(energy_raw, 0.98::DOUBLE), 6) AS theta FROM sc
 WHERE split = 'val' AND label >= 0 AND k <= ppi_len GROUP BY k""",
)
def energy_gate_threshold(spark: SparkSession, sf: str) -> DataFrame:
    val = em_scored(spark, sf).where("split = 'val'")
    t = C.reject_thresholds(val, [0.02], "energy_raw", 9)
    return t.select("k", F.round("theta", 6).alias("theta"))


@query(
    "prefix_classifier",
    Q.EM_SCORED + """ SELECT k, split, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN pred = label THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy
 FROM sc WHERE label >= 0 GROUP BY k, split""",
)
def prefix_classifier(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.long_scores(C.known_only(em_scored(spark, sf)), ["pred"], ["label", "split"])
    return rows.groupBy("k", "split").agg(
        F.count("*").alias("n"),
        F.round(F.avg((F.col("pred") == F.col("label")).cast("double")), 6).alias("accuracy"),
    )


@query("prefix_classifier_fitted")
def prefix_classifier_fitted(spark: SparkSession, sf: str) -> DataFrame:
    """Multinomial logistic regression on the first 2K features, K = 4 and 16."""
    from flowtide.operators.probes import prefix_regression

    flows = B.em_flows(spark, sf)
    parts = []
    for k in (4, 16):
        scored = prefix_regression(flows, k)
        parts.append(
            scored.groupBy("split").agg(
                F.count("*").alias("n"), F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy")
            ).withColumn("k", F.lit(k))
        )
    return parts[0].unionByName(parts[1])


@query(
    "nearest_neighbour_probe",
    Q.EM_LOGITS + """, n AS (SELECT flow_id, class_id, embedding::DOUBLE[] AS x FROM em),
 pr AS (SELECT q.flow_id AS query, q.class_id AS y, r.flow_id AS ref, r.class_id, round(list_dot_product(q.x, r.x), 9) AS sim
  FROM n q JOIN n r ON q.flow_id % 50 = 0 AND r.flow_id <> q.flow_id),
 tp AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY query ORDER BY sim DESC, ref) <= 20),
 vt AS (SELECT query, y, class_id, count(*) AS n FROM tp GROUP BY ALL)
SELECT query, CAST(any_value(y) AS INTEGER) AS class_id, CAST(arg_max(class_id, n * 100 - class_id) AS INTEGER) AS pred, CAST(max(n) AS BIGINT) AS votes FROM vt GROUP BY query""",
)
def nearest_neighbour_probe(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose id is divisible by 50 as queries against all others."""
    flows = B.em_flows(spark, sf)
    votes = C.nearest_vote(flows, flows.where(F.pmod("flow_id", F.lit(50)) == 0), digits=9)
    truth = flows.select(F.col("flow_id").alias("query"), "class_id")
    return votes.join(truth, "query").select("query", "class_id", "pred", "votes")


@query("linear_probe")
def linear_probe(spark: SparkSession, sf: str) -> DataFrame:
    from flowtide.operators.probes import linear_accuracy

    return linear_accuracy(B.em_flows(spark, sf))


GROUP_DRAW = R.lcg_draw_sql(1, "uniformity", "flow_id")


@query(
    "embedding_uniformity",
    Q.EM_LOGITS + f""", n AS (SELECT flow_id, embedding::DOUBLE[] AS x, {GROUP_DRAW} % ((SELECT count(*) FROM em) // 256 + 1) AS g FROM em)
SELECT round(ln(avg(exp(-2.0::DOUBLE * pow(list_distance(a.x, b.x), 2)))), 6) AS uniformity, CAST(count(*) AS BIGINT) AS n_pairs
FROM n a JOIN n b ON a.g = b.g AND a.flow_id <> b.flow_id""",
)
def embedding_uniformity(spark: SparkSession, sf: str) -> DataFrame:
    flows = B.em_flows(spark, sf)
    group = F.pmod(R.arithmetic(1)("uniformity", F.col("flow_id")), F.lit(flows.count() // 256 + 1))
    out = C.uniformity(flows, group)
    return out.select(F.round("uniformity", 6).alias("uniformity"), "n_pairs")
