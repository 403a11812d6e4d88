"""Queries over feature views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide import bindings as B
from flowtide import schema as S
from flowtide.functions import ppi as P
from flowtide.operators import assemble as A
from flowtide.operators import features as X
from flowtide.plans import sql as Q
from flowtide.plans.inputs import ev_flows, ev_long_flows
from flowtide.plans.registry import query

FL = Q.flows_sql()
LONG = Q.flows_sql(B.EV30_TIMEOUTS, rst=False)
TRAIN = ["WEEK-2024-01", "WEEK-2024-02"]
TRAIN_SQL = "period IN ('WEEK-2024-01','WEEK-2024-02')"


def with_duration(flows: DataFrame) -> DataFrame:
    """Duration in the unit of one ipt step (a second here)."""
    return flows.withColumn(
        "duration_units", (F.col("end_us") - F.col("start_us")) / F.lit(float(B.SECOND_US))
    )


def rounded(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*keep, *[F.round(c, 6).alias(c) for c in df.columns if c not in keep])


def round_sql(cols: list[str], source: str, keep: str) -> str:
    return f"SELECT {keep}, " + ", ".join(f"round({c}, 6) AS {c}" for c in cols) + f" FROM {source}"


STATS_SQL = f"""
SELECT f.flow_id, CAST(f.bytes AS DOUBLE) AS bytes, CAST(f.bytes_rev AS DOUBLE) AS bytes_rev,
  CAST(f.packets AS DOUBLE) AS packets, CAST(f.packets_rev AS DOUBLE) AS packets_rev,
  (f.end_us - f.start_us)/1000000.0::DOUBLE/1000.0::DOUBLE AS duration,
  CAST(f.ppi_len AS DOUBLE) AS ppi_len, coalesce(s.ppi_duration, 0) AS ppi_duration,
  coalesce(s.ppi_roundtrips, 0) AS ppi_roundtrips,
  {", ".join(f"coalesce(s.{c.lower()}, 0) AS {c.lower()}" for c in S.HIST_STATS)},
  {", ".join(f"CASE WHEN (f.flags_seen & {b}) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS flag_{n.lower()}" for n, b in S.FLAG_BITS.items())}
FROM fl f LEFT JOIN ps s ON s.flow_id = f.flow_id"""


@query(
    "flow_statistics",
    FL + f", ps AS ({Q.prefix_stats_sql('30')}), st AS ({STATS_SQL}) "
    + round_sql(X.STATS, "st", "flow_id"),
)
def flow_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.flowstats(with_duration(ev_flows(spark, sf))), ["flow_id"])


@query("flow_round_trips", FL + f", ps AS ({Q.prefix_stats_sql('30')}) SELECT flow_id, CAST(ppi_roundtrips AS BIGINT) AS round_trips FROM ps")
def flow_round_trips(spark: SparkSession, sf: str) -> DataFrame:
    flows = ev_flows(spark, sf).where("ppi_len > 0")
    return flows.select("flow_id", P.round_trips(F.col("ppi")).alias("round_trips"))


@query(
    "edge_histogram",
    FL + f"""
SELECT dir, CAST(size_bin AS INTEGER) AS size_bin, CAST(ipt_bin AS INTEGER) AS ipt_bin, CAST(count(*) AS BIGINT) AS n
FROM (SELECT dir, {Q.bin_sql('size', S.SIZE_EDGES)} AS size_bin, {Q.bin_sql('ipt', S.IPT_EDGES)} AS ipt_bin FROM pp)
GROUP BY 1,2,3""",
)
def edge_histogram(spark: SparkSession, sf: str) -> DataFrame:
    packets = A.packet_rows(ev_flows(spark, sf))
    return packets.groupBy(
        "dir",
        P.edge_bin(F.col("size"), S.SIZE_EDGES).alias("size_bin"),
        P.edge_bin(F.col("ipt"), S.IPT_EDGES).alias("ipt_bin"),
    ).agg(F.count("*").alias("n"))




TOKENS_SQL = f"""tk AS (SELECT flow_id, j, it.tok AS ipt_token, CASE WHEN dir=-1 THEN 2 ELSE 1 END AS dir_token,
  st.tok AS size_token, push + 1 AS push_token
FROM pp JOIN (SELECT v, CAST((SELECT count(*) FROM range(1, 64) r(i) WHERE pow(1500.0::DOUBLE, i/64.0::DOUBLE) < v) + 1 AS INTEGER) AS tok
              FROM (SELECT DISTINCT size AS v FROM pp)) st ON st.v = size
     JOIN (SELECT v, CAST((SELECT count(*) FROM range(1, 32) r(i) WHERE pow(32767.0::DOUBLE, i/32.0::DOUBLE) < v) + 1 AS INTEGER) AS tok
              FROM (SELECT DISTINCT ipt AS v FROM pp)) it ON it.v = ipt)"""


@query("flow_tokens", FL + f", {TOKENS_SQL} SELECT * FROM tk")
def flow_tokens(spark: SparkSession, sf: str) -> DataFrame:
    toks = ev_flows(spark, sf).select("flow_id", F.posexplode(P.tokens(F.col("ppi"))).alias("j0", "t"))
    return toks.select(
        "flow_id", (F.col("j0") + 1).alias("j"), F.col("t.ipt").alias("ipt_token"),
        F.col("t.dir").alias("dir_token"), F.col("t.size").alias("size_token"),
        F.col("t.push").alias("push_token"),
    )


@query(
    "flow_continuous_view",
    FL + """ SELECT flow_id, j, round(ln(1.0::DOUBLE+size)*dir, 6) AS size_dir, round(ln(1.0::DOUBLE+ipt), 6) AS log_ipt,
  CAST(dir AS DOUBLE) AS dir, CAST(push AS DOUBLE) AS push FROM pp""",
)
def flow_continuous_view(spark: SparkSession, sf: str) -> DataFrame:
    rows = ev_flows(spark, sf).select("flow_id", F.posexplode(P.continuous(F.col("ppi"))).alias("j0", "p"))
    return rows.select(
        "flow_id", (F.col("j0") + 1).alias("j"), F.round("p.size_dir", 6).alias("size_dir"),
        F.round("p.log_ipt", 6).alias("log_ipt"), "p.dir", "p.push",
    )


@query(
    "flow_padding_mask",
    FL + " SELECT flow_id, list_transform(range(0, 30), lambda j: j < least(ppi_len, 8)) AS mask FROM fl",
)
def flow_padding_mask(spark: SparkSession, sf: str) -> DataFrame:
    return ev_flows(spark, sf).select("flow_id", P.padding_mask(F.col("ppi_len"), 8).alias("mask"))


@query(
    "flow_prefix_cut",
    LONG + """ SELECT f.flow_id, f.ppi_len AS len_a, least(f.ppi_len, 8) AS len_b, CAST(count(*) AS BIGINT) AS n,
 CAST(sum(size) AS BIGINT) AS bytes FROM fl f JOIN pp ON pp.flow_id=f.flow_id WHERE j <= 8 GROUP BY ALL""",
)
def flow_prefix_cut(spark: SparkSession, sf: str) -> DataFrame:
    flows = ev_long_flows(spark, sf)
    a = X.cut_prefix(flows, 8).select(
        "flow_id", F.col("ppi_len").alias("len_a"), F.size("ppi").cast("bigint").alias("n"),
        P.total(F.col("ppi"), lambda p: p["size"]).alias("bytes"), "ppi",
    )
    return X.cut_prefix(a.withColumn("ppi_len", F.col("len_a")), 8, cap_length=True).select(
        "flow_id", "len_a", F.col("ppi_len").alias("len_b"), "n", "bytes"
    )


def _prefix_sql(k: int) -> str:
    return FL + f", st AS ({Q.prefix_stats_sql(str(k))}) " + round_sql(X.STATS, "st", "flow_id")


@query("prefix_stats_k8", _prefix_sql(8))
def prefix_stats_k8(spark: SparkSession, sf: str) -> DataFrame:
    """For every flow, the statistics of its first eight packets."""
    return rounded(X.prefix_flowstats(ev_flows(spark, sf), 8), ["flow_id"])


GRID_ROWS = (
    "gp AS (SELECT pp.*, k FROM pp CROSS JOIN (SELECT unnest([1,2,3,4,5,6,8,10,12,15,20,25,30]) AS k) WHERE j <= k)"
)


@query(
    "prefix_stats_grid",
    LONG + f", {GRID_ROWS}, st AS ({Q.prefix_stats_sql('30', 'gp', 'flow_id, k')}) "
    + round_sql(X.STATS, "st", "flow_id, k"),
)
def prefix_stats_grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.prefix_grid(ev_long_flows(spark, sf)), ["flow_id", "k"])


def _scaled_sql(source: str) -> str:
    out = [f"ln(1.0::DOUBLE + greatest({c}, 0)) AS {c}" for c in X.LOG_STATS]
    for b in S.HIST_BLOCKS:
        cols = [f"{b.lower()}_{i}" for i in range(S.N_BINS)]
        tot = "(" + "+".join(cols) + ")"
        out += [f"CASE WHEN {tot} > 0 THEN {c}/{tot} ELSE 0 END AS {c}" for c in cols]
    out += [f"flag_{n.lower()}" for n in S.FLAG_BITS]
    return f"SELECT flow_id, period, {', '.join(out)} FROM {source}"


STATS_CTE = f"ps AS ({Q.prefix_stats_sql('30')}), st0 AS ({STATS_SQL}), st AS (SELECT st0.*, fl.period FROM st0 JOIN fl USING (flow_id))"
SCALED_CTE = f"sc AS ({_scaled_sql('st')})"


def _fit_sql(where: str) -> str:
    cont = {
        "size_dir": "ln(1.0::DOUBLE+size)*dir", "log_ipt": "ln(1.0::DOUBLE+ipt)",
        "dir": "CAST(dir AS DOUBLE)", "push": "CAST(push AS DOUBLE)",
    }
    parts = [
        f"SELECT 'continuous' AS view, '{n}' AS \"column\", avg({e}) AS mean,"
        f" CASE WHEN stddev_pop({e}) < 1e-8 THEN 1.0 ELSE stddev_pop({e}) END AS std"
        f" FROM pp JOIN fl USING (flow_id) WHERE {where}"
        for n, e in cont.items()
    ] + [
        f"SELECT 'flowstats', '{c}', avg({c}), CASE WHEN stddev_pop({c}) < 1e-8 THEN 1.0 ELSE stddev_pop({c}) END"
        f" FROM sc WHERE {where}"
        for c in X.STATS
    ]
    return " UNION ALL ".join(parts)


@query(
    "standardizer_fit",
    FL + f", {STATS_CTE}, {SCALED_CTE}, ft AS ({_fit_sql(TRAIN_SQL)})"
    " SELECT view, \"column\", round(mean, 6) AS mean, round(std, 6) AS std FROM ft",
)
def standardizer_fit(spark: SparkSession, sf: str) -> DataFrame:
    flows = with_duration(ev_flows(spark, sf)).where(F.col("period").isin(TRAIN))
    fit = X.fit_standardizer(flows, X.flowstats(flows, []))
    return fit.select("view", "column", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(
    "standardizer_fit_many",
    FL + f", {STATS_CTE}, {SCALED_CTE}, ft AS ({_fit_sql(TRAIN_SQL)})"
    " SELECT view, \"column\", round(mean, 6) AS mean, round(std, 6) AS std FROM ft",
)
def standardizer_fit_many(spark: SparkSession, sf: str) -> DataFrame:
    flows = with_duration(ev_flows(spark, sf))
    weeks = [flows.where(F.col("period") == w) for w in TRAIN]
    fit = X.fit_many(weeks, [X.flowstats(w, []) for w in weeks])
    return fit.select("view", "column", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(
    "standardizer_transform_stats",
    FL + f", {STATS_CTE}, {SCALED_CTE} SELECT flow_id, "
    + ", ".join(
        f"round(({c} - (SELECT avg({c}) FROM sc WHERE {TRAIN_SQL})) / (SELECT CASE WHEN stddev_pop({c}) < 1e-8"
        f" THEN 1.0 ELSE stddev_pop({c}) END FROM sc WHERE {TRAIN_SQL}), 6) AS {c}"
        for c in ["bytes", "duration", "psize_hist_3", "ipt_hist_rev_2", "flag_psh"]
    )
    + " FROM sc",
)
def standardizer_transform_stats(spark: SparkSession, sf: str) -> DataFrame:
    flows = with_duration(ev_flows(spark, sf))
    train = flows.where(F.col("period").isin(TRAIN))
    fit = X.fit_standardizer(train, X.flowstats(train, []))
    out = X.transform_flowstats(X.flowstats(flows), fit)
    return rounded(
        out.select("flow_id", "bytes", "duration", "psize_hist_3", "ipt_hist_rev_2", "flag_psh"), ["flow_id"]
    )


@query(
    "standardizer_transform_packets",
    FL + f""", m AS (SELECT avg(ln(1.0::DOUBLE+size)*dir) AS a, stddev_pop(ln(1.0::DOUBLE+size)*dir) AS b,
  avg(ln(1.0::DOUBLE+ipt)) AS c, stddev_pop(ln(1.0::DOUBLE+ipt)) AS d FROM pp JOIN fl USING (flow_id) WHERE {TRAIN_SQL})
SELECT f.flow_id, CAST(p.j AS INTEGER) AS j, coalesce(round((ln(1.0::DOUBLE+size)*dir - a)/b, 6), 0.0::DOUBLE) AS size_dir,
  coalesce(round((ln(1.0::DOUBLE+ipt) - c)/d, 6), 0.0::DOUBLE) AS log_ipt
FROM fl f CROSS JOIN (SELECT unnest(range(1, 31)) AS j) p CROSS JOIN m LEFT JOIN pp ON pp.flow_id=f.flow_id AND pp.j=p.j""",
)
def standardizer_transform_packets(spark: SparkSession, sf: str) -> DataFrame:
    flows = with_duration(ev_flows(spark, sf))
    train = flows.where(F.col("period").isin(TRAIN))
    fit = X.fit_continuous(train).withColumn("view", F.lit("continuous"))
    out = X.transform_continuous(flows, fit).select("flow_id", F.posexplode("cont").alias("j0", "p"))
    return out.select(
        "flow_id", (F.col("j0") + 1).alias("j"), F.round("p.size_dir", 6).alias("size_dir"),
        F.round("p.log_ipt", 6).alias("log_ipt"),
    )


@query(
    "histogram_proportions",
    FL + f", {STATS_CTE}, {SCALED_CTE} "
    + round_sql([f"{b.lower()}_{i}" for b in S.HIST_BLOCKS for i in range(S.N_BINS)], "sc", "flow_id"),
)
def histogram_proportions(spark: SparkSession, sf: str) -> DataFrame:
    cols = [f"{b.lower()}_{i}" for b in S.HIST_BLOCKS for i in range(S.N_BINS)]
    out = X.scaled_stats(X.flowstats(with_duration(ev_flows(spark, sf))))
    return rounded(out.select("flow_id", *cols), ["flow_id"])


@query(
    "sequence_twins",
    FL + f""", {TOKENS_SQL}, sq AS (SELECT f.flow_id, f.label, coalesce(string_agg(ipt_token||','||dir_token||','||size_token||','||push_token, ';' ORDER BY j), '') AS s
  FROM fl f LEFT JOIN tk ON tk.flow_id=f.flow_id GROUP BY f.flow_id, f.label),
 pl2 AS (SELECT s, label, count(*) AS n FROM sq GROUP BY s, label),
 tw AS (SELECT s, sum(n) AS n, max(n) AS n_major FROM pl2 GROUP BY s)
SELECT CAST(sum(n) AS BIGINT) AS n_flows, CAST(count(*) AS BIGINT) AS n_sequences,
  CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS n_with_twin,
  round(1.0::DOUBLE - CAST(count(*) AS DOUBLE)/sum(n), 6) AS duplicate_rate,
  round(CAST(sum(n_major) AS DOUBLE)/sum(n), 6) AS label_ceiling FROM tw""",
)
def sequence_twins(spark: SparkSession, sf: str) -> DataFrame:
    out = X.duplicate_report(ev_flows(spark, sf))
    return rounded(out, ["n_flows", "n_sequences", "n_with_twin"])


@query("flow_packet_rows", LONG + " SELECT flow_id, j, ipt, dir, size, push FROM pp")
def flow_packet_rows(spark: SparkSession, sf: str) -> DataFrame:
    return A.packet_rows(ev_long_flows(spark, sf))


@query(
    "flow_training_frame",
    FL + f""", {TOKENS_SQL} SELECT f.flow_id, f.label AS y, f.ppi_len, CAST(count(tk.j) AS BIGINT) AS n_real,
  CAST(coalesce(sum(size_token), 0) AS BIGINT) AS size_tokens FROM fl f LEFT JOIN tk ON tk.flow_id=f.flow_id
 WHERE {TRAIN_SQL} GROUP BY ALL""",
)
def flow_training_frame(spark: SparkSession, sf: str) -> DataFrame:
    flows = ev_flows(spark, sf).where(F.col("period").isin(TRAIN))
    fit = X.fit_continuous(flows).withColumn("view", F.lit("continuous"))
    frame = X.training_frame(flows, fit, train=True)
    return frame.select(
        "flow_id", "y", "ppi_len",
        F.size(F.filter("mask", lambda m: m)).cast("bigint").alias("n_real"),
        F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, t: a + t["size"]).alias("size_tokens"),
    )
