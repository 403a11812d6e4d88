"""Queries over flow assembly."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide import bindings as B
from flowtide.operators import assemble as A
from flowtide.plans import sql as Q
from flowtide.plans.inputs import ev_flows, ev_long_flows
from flowtide.plans.registry import query

IDLE_ONLY = replace(B.EV_TIMEOUTS, active_us=None, linger_us=None)
NO_LINGER = replace(B.EV_TIMEOUTS, linger_us=None)
#: every 11th event arrives with a clock that is three hours behind
JUMP_SQL = "CASE WHEN event_id % 11 = 0 THEN 10800000000 ELSE 0 END"

SHAPE = [
    "flow_key", "flow_id", "start_us", "end_us", "packets", "packets_rev", "bytes", "bytes_rev",
    "flags_seen", "ppi_len",
]
SHAPE_SQL = "SELECT " + ", ".join(SHAPE) + " FROM fl"


@query(
    "flow_bidirectional_keys",
    f"""WITH {Q.packets_sql()}
SELECT least(flow_key, flow_key % 50) AS lo, greatest(flow_key, flow_key % 50) AS hi,
  CAST(sum(CASE WHEN s = least(flow_key, flow_key % 50) THEN 1 ELSE 0 END) AS BIGINT) AS from_lo,
  CAST(sum(CASE WHEN s <> least(flow_key, flow_key % 50) THEN 1 ELSE 0 END) AS BIGINT) AS from_hi
FROM (SELECT *, CASE WHEN side = 0 THEN flow_key ELSE flow_key % 50 END AS s FROM pk)
GROUP BY 1, 2""",
)
def flow_bidirectional_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Both directions of a conversation between user and user % 50 share one key."""
    user, peer = F.col("flow_key"), F.pmod("flow_key", F.lit(50))
    port = F.lit(443)
    ends = B.ev_packets(spark, sf).select(
        F.struct(F.when(F.col("src") == "A", user).otherwise(peer).alias("ip"), port.alias("port")).alias("src"),
        F.struct(F.when(F.col("src") == "A", peer).otherwise(user).alias("ip"), port.alias("port")).alias("dst"),
        "proto",
    )
    return (
        A.bidirectional_key(ends)
        .groupBy(F.col("flow_key.lo.ip").alias("lo"), F.col("flow_key.hi.ip").alias("hi"))
        .agg(
            F.count(F.when(F.col("side") == 0, 1)).alias("from_lo"),
            F.count(F.when(F.col("side") == 1, 1)).alias("from_hi"),
        )
    )


@query(
    "flow_direction",
    Q.flows_sql() + " SELECT flow_id, initiator, packets, packets_rev FROM fl",
)
def flow_direction(spark: SparkSession, sf: str) -> DataFrame:
    return ev_flows(spark, sf).select("flow_id", "initiator", "packets", "packets_rev")


@query("flow_idle_split", Q.flows_sql(IDLE_ONLY, rst=False) + SHAPE_SQL.replace("SELECT", " SELECT"))
def flow_idle_split(spark: SparkSession, sf: str) -> DataFrame:
    packets = B.event_packets(B.table(spark, sf, "events"), rst=False)
    return A.assemble(packets, IDLE_ONLY).select(*SHAPE)


@query("flow_reset_close", Q.flows_sql(IDLE_ONLY) + " " + SHAPE_SQL)
def flow_reset_close(spark: SparkSession, sf: str) -> DataFrame:
    return A.assemble(B.ev_packets(spark, sf), IDLE_ONLY).select(*SHAPE)


@query("flow_active_split", Q.flows_sql(NO_LINGER) + " " + SHAPE_SQL)
def flow_active_split(spark: SparkSession, sf: str) -> DataFrame:
    return A.assemble(B.ev_packets(spark, sf), NO_LINGER).select(*SHAPE)


@query("flow_fin_linger", Q.flows_sql() + " " + SHAPE_SQL)
def flow_fin_linger(spark: SparkSession, sf: str) -> DataFrame:
    return A.assemble(B.ev_packets(spark, sf), B.EV_TIMEOUTS).select(*SHAPE)


@query(
    "flow_key_reuse",
    Q.flows_sql()
    + " SELECT flow_key, CAST(count(*) AS BIGINT) AS n_flows, CAST(min(start_us) AS BIGINT) AS first_us,"
    " CAST(max(start_us) AS BIGINT) AS last_us FROM fl GROUP BY flow_key",
)
def flow_key_reuse(spark: SparkSession, sf: str) -> DataFrame:
    return (
        ev_flows(spark, sf)
        .groupBy("flow_key")
        .agg(
            F.count("*").alias("n_flows"),
            F.min("start_us").alias("first_us"),
            F.max("start_us").alias("last_us"),
        )
    )


@query(
    "flow_counters",
    Q.flows_sql()
    + " SELECT flow_id, packets, packets_rev, bytes, bytes_rev, flags_seen FROM fl",
)
def flow_counters(spark: SparkSession, sf: str) -> DataFrame:
    return ev_flows(spark, sf).select(
        "flow_id", "packets", "packets_rev", "bytes", "bytes_rev", "flags_seen"
    )


@query("flow_packet_sequence", Q.flows_sql() + " SELECT flow_id, j, ipt, dir, size, push FROM pp")
def flow_packet_sequence(spark: SparkSession, sf: str) -> DataFrame:
    return A.packet_rows(ev_flows(spark, sf))


@query(
    "flow_long_sequence",
    Q.flows_sql(B.EV30_TIMEOUTS, rst=False) + " SELECT flow_id, j, ipt, dir, size, push FROM pp",
)
def flow_long_sequence(spark: SparkSession, sf: str) -> DataFrame:
    return A.packet_rows(ev_long_flows(spark, sf))


CLOCK_JUMPS_SQL = (
    Q.flows_sql(jump=JUMP_SQL).replace("ORDER BY ts, event_id) AS rn", "ORDER BY event_id) AS rn")
    + " SELECT flow_key, flow_id, start_us, end_us, clock_jumps, ppi_len FROM fl"
)


def jumping(spark: SparkSession, sf: str, hot_rows: int = A.HOT_ROWS) -> DataFrame:
    """Flows in arrival order of packets whose clock steps back three hours now and then."""
    packets = B.ev_packets(spark, sf).withColumn(
        "ts_us",
        F.col("ts_us") - F.when(F.col("pkt_id") % 11 == 0, F.lit(10_800_000_000)).otherwise(F.lit(0)),
    )
    return A.assemble(packets, B.EV_TIMEOUTS, order=["pkt_id"], hot_rows=hot_rows).select(
        "flow_key", "flow_id", "start_us", "end_us", "clock_jumps", "ppi_len"
    )


@query("flow_clock_jumps", CLOCK_JUMPS_SQL)
def flow_clock_jumps(spark: SparkSession, sf: str) -> DataFrame:
    return jumping(spark, sf)


@query("flow_hot_arrival", CLOCK_JUMPS_SQL)
def flow_hot_arrival(spark: SparkSession, sf: str) -> DataFrame:
    """The same where every key counts as hot."""
    return jumping(spark, sf, hot_rows=2)


@query(
    "flow_end_reason",
    Q.flows_sql() + f" SELECT flow_id, {Q.reason_sql()} AS end_reason FROM fl",
)
def flow_end_reason(spark: SparkSession, sf: str) -> DataFrame:
    return ev_flows(spark, sf).select("flow_id", "end_reason")


@query(
    "flow_listing",
    Q.flows_sql()
    + f""" SELECT flow_id, flow_key, start_us, {Q.reason_sql()} AS end_reason, ppi_len
FROM fl ORDER BY start_us, flow_id""",
)
def flow_listing(spark: SparkSession, sf: str) -> DataFrame:
    return A.by_start(ev_flows(spark, sf)).select(
        "flow_id", "flow_key", "start_us", "end_reason", "ppi_len"
    )


@query("flow_hot_keys", Q.flows_sql() + " " + SHAPE_SQL)
def flow_hot_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The chunked path: every key above the mean number of packets per key counts as hot."""
    packets = B.ev_packets(spark, sf)
    n = packets.agg((F.count("*") / F.count_distinct("flow_key")).alias("m")).first()["m"]
    return A.assemble(packets, B.EV_TIMEOUTS, hot_rows=max(int(n), 2)).select(*SHAPE)


