"""How the shared test tables stand in for packets and for prefix scores.

``ev``: every event is a packet of the conversation of its user. One second plays the part of
one millisecond, so gaps, timeouts and durations are scaled together.

``em``: every embedding is a flow; its prefix of K packets is the first 2K dimensions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide import schema as S
from flowtide.functions.labels import week_label

SECOND_US = 1_000_000

EV_IDLE_S, EV_ACTIVE_S, EV_LINGER_S = 43_200, 86_400, 21_600

EM_HELD_OUT = [8, 9]
EM_CLASSES = 8
EM_SCALE = 80.0


@dataclass(frozen=True)
class Timeouts:
    """Closing rules in microseconds; ``ipt_unit_us`` is the length of one ipt unit."""

    idle_us: int = 30 * SECOND_US
    active_us: int | None = 300 * SECOND_US
    linger_us: int | None = 5 * SECOND_US
    udp_idle_us: int | None = None
    ipt_unit_us: int = 1000

    @property
    def udp(self) -> int:
        return self.idle_us if self.udp_idle_us is None else self.udp_idle_us


EV_TIMEOUTS = Timeouts(
    idle_us=EV_IDLE_S * SECOND_US,
    active_us=EV_ACTIVE_S * SECOND_US,
    linger_us=EV_LINGER_S * SECOND_US,
    ipt_unit_us=SECOND_US,
)
#: no closing at all: one flow per user, longer than 30 packets
EV30_TIMEOUTS = Timeouts(
    idle_us=10**15, active_us=None, linger_us=None, ipt_unit_us=SECOND_US
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_packets(events: DataFrame, rst: bool = True) -> DataFrame:
    """Events as packets in the shape of ``schema.PACKETS``."""
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    flags = (
        F.lit(S.ACK)
        + F.when(kind == "signup", F.lit(S.SYN)).otherwise(F.lit(0))
        + F.when((kind == "error") & F.lit(rst), F.lit(S.RST)).otherwise(F.lit(0))
        + F.when(kind == "view", F.lit(S.PSH)).otherwise(F.lit(0))
        + F.when((k < 15) & F.lit(rst), F.lit(S.FIN)).otherwise(F.lit(0))
    )
    return events.select(
        F.col("user_id").alias("flow_key"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.col("event_id").alias("pkt_id"),
        F.when(kind.isin("click", "signup", "error"), F.lit("A")).otherwise(F.lit("B")).alias("src"),
        F.lit(S.TCP).alias("proto"),
        F.when(kind == "signup", F.lit(0).cast("bigint"))
        .otherwise(F.floor(F.col("value") * F.lit(10.0)).cast("bigint"))
        .alias("payload_len"),
        flags.cast("int").alias("flags"),
    )


def ev_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_packets(table(spark, sf_dir, "events"))


def ev_dimensions(flows: DataFrame) -> DataFrame:
    """Class, category, session, period and split of ``ev`` flows."""
    start = F.timestamp_micros(F.col("start_us"))
    period = week_label(start)
    return flows.select(
        "*",
        F.pmod(F.col("flow_key"), F.lit(7)).cast("int").alias("label"),
        F.pmod(F.col("flow_key"), F.lit(3)).cast("int").alias("category"),
        F.pmod(F.col("flow_key"), F.lit(20)).cast("int").alias("session_id"),
        period.alias("period"),
    )


EV_SPLITS = [
    ("train", 0, "WEEK-2024-01"),
    ("train", 0, "WEEK-2024-02"),
    ("val", 1, "WEEK-2024-03"),
    ("test_id", 2, "WEEK-2024-04"),
    ("test_drift", 3, "WEEK-2024-05"),
]


def em_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as flows: id, label (-1 when the class is held out), split, length, period."""
    vec = F.col("vec_id")
    cls: Column = F.col("label").cast("int")
    slot = F.pmod(vec, F.lit(5))
    return table(spark, sf_dir, "embeddings").select(
        vec.alias("flow_id"),
        cls.alias("class_id"),
        F.when(cls.isin(*EM_HELD_OUT), F.lit(S.UNKNOWN)).otherwise(cls).alias("label"),
        F.when(slot <= 2, F.lit("train"))
        .when(slot == 3, F.lit("val"))
        .otherwise(F.lit("test"))
        .alias("split"),
        (F.lit(3) + F.pmod(vec * 7, F.lit(28))).cast("int").alias("ppi_len"),
        F.floor(vec / 100).cast("int").alias("period"),
        F.transform(F.col("embedding"), lambda x: x.cast("double")).alias("x"),
    )
