"""Queries over damage transforms (on the long flows)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide import bindings as B
from flowtide.functions import draws as R
from flowtide.operators import assemble as A
from flowtide.operators import damage as G
from flowtide.plans import sql as Q
from flowtide.plans.inputs import ev_long_flows
from flowtide.plans.registry import query

LONG = Q.flows_sql(B.EV30_TIMEOUTS, rst=False)
SEED = 7


def u_sql(purpose: str, j: str) -> str:
    return f"({R.lcg_draw_sql(SEED, purpose, f'flow_id * 64 + {j}')})::DOUBLE / 2147483648.0::DOUBLE"


def n_sql(purpose: str, j: str) -> str:
    return f"sqrt(-2.0::DOUBLE * ln(greatest({u_sql(purpose + '/r', j)}, {2.0**-31!r}::DOUBLE))) * cos({2 * math.pi!r}::DOUBLE * {u_sql(purpose + '/a', j)})"


def flows_of(spark: SparkSession, sf: str) -> tuple[DataFrame, G.Draw]:
    return ev_long_flows(spark, sf).where("ppi_len > 0"), G.arith_draw(SEED, F.col("flow_id"))


def packets(df: DataFrame, ppi: F.Column, keep: tuple[str, ...] = ("flow_id",)) -> DataFrame:
    return A.packet_rows(df.select(*keep, ppi.alias("ppi")), keep)


def dropped_sql(mask: str) -> str:
    return f"""mk AS (SELECT *, {mask} AS keep, sum(ipt) OVER (PARTITION BY flow_id ORDER BY j) AS cum FROM pp),
kp AS (SELECT *, row_number() OVER w AS nj, lag(cum) OVER w AS before FROM mk WHERE keep WINDOW w AS (PARTITION BY flow_id ORDER BY j)),
dr AS (SELECT flow_id, CAST(nj AS INTEGER) AS j, CAST(CASE WHEN nj = 1 THEN 0 ELSE least(cum - before, 32767) END AS INTEGER) AS ipt, dir, size, push FROM kp)"""


OUT = "SELECT flow_id, j, ipt, dir, size, push FROM dr"


@query("drop_with_mask", LONG + f", {dropped_sql('(flow_id + j * 7) % 3 <> 0 OR j = 5')} {OUT}")
def drop_with_mask(spark: SparkSession, sf: str) -> DataFrame:
    flows, _ = flows_of(spark, sf)
    keep = F.transform("ppi", lambda p, j: ((F.col("flow_id") + (j + 1) * 7) % 3 != 0) | (j == 4))
    return packets(flows, G.drop_with_mask(F.col("ppi"), keep))


RESCUE = "least(floor(" + u_sql("drop/rescue", "0") + " * count(*) OVER (PARTITION BY flow_id)), count(*) OVER (PARTITION BY flow_id) - 1)"
DROP_MASK = f"CASE WHEN max(CASE WHEN {u_sql('drop', '(j - 1)')} >= 0.3::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY flow_id) = 1 THEN {u_sql('drop', '(j - 1)')} >= 0.3::DOUBLE ELSE j - 1 = {RESCUE} END"


@query("packet_drop", LONG + f", {dropped_sql(DROP_MASK)} {OUT}")
def packet_drop(spark: SparkSession, sf: str) -> DataFrame:
    flows, draw = flows_of(spark, sf)
    return packets(flows, G.drop(F.col("ppi"), 0.3, draw))


@query(
    "neighbour_swap",
    LONG + f""", wn AS (SELECT *, {u_sql('swap', '(j - 1)')} < 0.4::DOUBLE AND j < count(*) OVER (PARTITION BY flow_id) AS w FROM pp),
sw AS (SELECT flow_id, j, w AS s FROM wn WHERE j = 1 UNION ALL SELECT n.flow_id, n.j, n.w AND NOT sw.s FROM sw JOIN wn n ON n.flow_id = sw.flow_id AND n.j = sw.j + 1),
mv AS (SELECT p.*, CASE WHEN a.s THEN p.j + 1 WHEN coalesce(b.s, FALSE) THEN p.j - 1 ELSE p.j END AS nj FROM pp p JOIN sw a ON a.flow_id = p.flow_id AND a.j = p.j
  LEFT JOIN sw b ON b.flow_id = p.flow_id AND b.j = p.j - 1),
dr AS (SELECT flow_id, CAST(nj AS INTEGER) AS j, CASE WHEN nj = 1 THEN 0 ELSE ipt END AS ipt, dir, size, push FROM mv) {OUT}""",
)
def neighbour_swap(spark: SparkSession, sf: str) -> DataFrame:
    flows, draw = flows_of(spark, sf)
    return packets(flows, G.swap_neighbours(F.col("ppi"), 0.4, draw))


@query(
    "gap_jitter",
    LONG + f", dr AS (SELECT flow_id, j, CAST(CASE WHEN j = 1 OR ipt <= 0 THEN 0 ELSE least(floor(ipt * exp(0.5::DOUBLE * {n_sql('ipt', '(j - 1)')}) + 0.5::DOUBLE), 32767) END AS INTEGER) AS ipt, dir, size, push FROM pp) {OUT}",
)
def gap_jitter(spark: SparkSession, sf: str) -> DataFrame:
    flows, draw = flows_of(spark, sf)
    return packets(flows, G.jitter_gaps(F.col("ppi"), 0.5, draw))


@query(
    "size_jitter",
    LONG + f", dr AS (SELECT flow_id, j, ipt, dir, CAST(least(greatest(round_even(size + 20.0::DOUBLE * {n_sql('size', '(j - 1)')}, 0), 1), 1500) AS INTEGER) AS size, push FROM pp) {OUT}",
)
def size_jitter(spark: SparkSession, sf: str) -> DataFrame:
    flows, draw = flows_of(spark, sf)
    return packets(flows, G.jitter_sizes(F.col("ppi"), 20.0, draw))


@query(
    "random_crop",
    LONG + f" SELECT flow_id, ppi_len, least(CAST(floor({u_sql('crop', '0')} * 29) AS INTEGER) + 2, greatest(ppi_len, 1)) AS k FROM fl",
)
def random_crop(spark: SparkSession, sf: str) -> DataFrame:
    flows, draw = flows_of(spark, sf)
    return flows.select("flow_id", "ppi_len", G.random_crop(F.col("ppi_len"), draw).alias("k"))


@query(
    "prefix_crop",
    LONG + f" SELECT flow_id, CASE WHEN least(30, ppi_len - 1) >= 3 THEN CAST(floor({u_sql('prefix-crop', '0')} * greatest(least(30, ppi_len - 1) - 2, 1)) AS INTEGER) + 3 ELSE ppi_len END AS k, least(30, ppi_len - 1) >= 3 AS eligible FROM fl",
)
def prefix_crop(spark: SparkSession, sf: str) -> DataFrame:
    flows, draw = flows_of(spark, sf)
    k, ok = G.prefix_crop(F.col("ppi_len"), draw)
    return flows.select("flow_id", k.alias("k"), ok.alias("eligible"))


@query(
    "position_mask",
    LONG + f""", r AS (SELECT flow_id, j, row_number() OVER (PARTITION BY flow_id ORDER BY {u_sql('mask', '(j - 1)')}, j) AS rk, count(*) OVER (PARTITION BY flow_id) AS n FROM pp)
SELECT flow_id, j, rk <= greatest(1, round_even(n * 0.15::DOUBLE, 0)) AS masked FROM r""",
)
def position_mask(spark: SparkSession, sf: str) -> DataFrame:
    flows, draw = flows_of(spark, sf)
    m = flows.select("flow_id", F.posexplode(G.position_mask(F.col("ppi"), 0.15, draw)).alias("j0", "masked"))
    return m.select("flow_id", (F.col("j0") + 1).alias("j"), "masked")


CONDS = [
    {"name": "drop10", "kind": "drop", "value": 0.1},
    {"name": "swap20", "kind": "reorder", "value": 0.2},
    {"name": "gaps", "kind": "ipt_jitter", "value": 0.3},
    {"name": "sizes", "kind": "size_jitter", "value": 30.0},
]


def damaged(spark: SparkSession, sf: str) -> DataFrame:
    flows = ev_long_flows(spark, sf).where("ppi_len > 0")

    def draws(name: str) -> G.Draw:
        inner = G.hash_draw(SEED, F.col("flow_id"))
        return lambda purpose, j: inner(f"{name}/{purpose}", j)

    return G.damage(flows.select("flow_id", "label", "ppi", "ppi_len"), G.conditions(CONDS), draws)


@query("damage_conditions")
def damage_conditions(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.packet_rows(damaged(spark, sf), ("condition", "flow_id"))
    return rows.groupBy("condition").agg(
        F.count("*").alias("packets"), F.count_distinct("flow_id").alias("flows"), F.sum("size").alias("bytes"),
        F.sum("ipt").alias("time"),
    )


@query(
    "purpose_draws",
    f"SELECT event_id, {R.lcg_draw_sql(SEED, 'a', 'event_id')} AS a, {R.lcg_draw_sql(SEED, 'b', 'event_id')} AS b FROM events",
)
def purpose_draws(spark: SparkSession, sf: str) -> DataFrame:
    e = B.table(spark, sf, "events").select("event_id")
    return e.select(
        "event_id", R.lcg_draw(SEED, "a", F.col("event_id")).alias("a"), R.lcg_draw(SEED, "b", F.col("event_id")).alias("b")
    )
