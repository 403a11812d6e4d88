"""Queries over streams: events are written by Spark as files and read back as a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide import bindings as B
from flowtide.operators import policies as H
from flowtide.operators.budget import Loop
from flowtide.operators import scores as C
from flowtide.plans import sql as Q
from flowtide.plans.features import LONG, TOKENS_SQL
from flowtide.plans.inputs import ev_long_flows
from flowtide.plans.registry import query
from flowtide.session import cut, scratch_path
from flowtide.streaming import engine as E
from flowtide.streaming import flows as SF
from flowtide.streaming import loops as L
from flowtide.streaming import replay as RP
from flowtide.streaming import run as RUN

BATCHES = 3
N = 7


def packet_stream(spark: SparkSession, sf: str, batches: int = BATCHES) -> DataFrame:
    packets = B.ev_packets(spark, sf).select(
        "*", F.when(F.col("src") == "A", F.lit(0)).otherwise(F.lit(1)).alias("side"), F.timestamp_micros("ts_us").alias("event_time")
    )
    path = scratch_path(spark, "packets")
    files = RP.write_in_order(SF.with_flush(packets), path, F.col("ts_us"), batches, "flow_key")
    return RP.read_stream(spark, path, SF.PACKETS, files)


SHAPE = "flow_key, flow_id, start_us, end_us, packets, packets_rev, bytes, bytes_rev, flags_seen, ppi_len"


@query("stream_flow_assembly", Q.flows_sql() + f" SELECT {SHAPE}, {Q.reason_sql()} AS end_reason FROM fl")
def stream_flow_assembly(spark: SparkSession, sf: str) -> DataFrame:
    """Flows closed by a stateful stream in three micro-batches; the same flows as in batch."""
    flows = SF.flow_stream(packet_stream(spark, sf), B.EV_TIMEOUTS, timers=False)
    return RUN.run_to_table(flows, "flows").select(*SHAPE.split(", "), "end_reason")


def scored_flows(spark: SparkSession, sf: str) -> tuple[DataFrame, C.ScoreModel, list[float | None]]:
    """Long flows with the 60 packet features; scorer fitted on even users, thresholds on odd ones."""
    flows = ev_long_flows(spark, sf).where("ppi_len > 0").withColumn("x", E.feature_column(F.col("ppi")))
    flows = flows.withColumn("label", F.when(F.col("label") == 6, F.lit(-1)).otherwise(F.col("label")))
    flows = cut(flows.select("flow_id", "flow_key", "label", "ppi", "ppi_len", "x", "start_us", F.lit(0).alias("period")))
    even = F.col("flow_key") % 2 == 0
    model = C.ScoreModel(C.fit_centroids(flows.where(even), N, 0.05, digits=9), digits=6, mean_digits=12)
    val = C.score_flows(flows.where(~even).drop("ppi"), model)
    theta = C.theta_array(C.reject_thresholds(val, [0.1], "energy_raw", 9), 0.1)
    return flows, model, theta


def event_files(spark: SparkSession, flows: DataFrame, batches: int = BATCHES) -> DataFrame:
    events = RP.schedule(RP.capture_starts(flows, 1000.0), speed=1.0)
    path = scratch_path(spark, "events")
    files = RP.write_in_order(events, path, F.unix_micros("event_time"), batches, "flow_id")
    return RP.read_stream(spark, path, RP.EVENTS, files)


RULES = E.Rules(theta_commit=0.35, idle_s=86_400.0, unknown="energy_raw", trace=True)


def stream_decisions(spark: SparkSession, sf: str, batches: int = BATCHES) -> tuple[DataFrame, DataFrame]:
    """(stream rows, batch decisions of the same flows)."""
    flows, model, theta = scored_flows(spark, sf)
    rows = RUN.run_to_table(
        E.decide_stream(event_files(spark, flows, batches), [E.Version(model, theta_reject=tuple(theta))], RULES), "decisions"
    )
    scores = C.score_flows(flows.drop("ppi"), model).withColumn("u", F.col("energy_raw"))
    return rows, H.safe_stop(scores, RULES.theta_commit, theta)


@query(
    "stream_equals_batch",
    LONG + " SELECT CAST(count(*) AS BIGINT) AS flows, CAST(0 AS BIGINT) AS different FROM fl WHERE ppi_len > 0",
)
def stream_equals_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions of the stream next to the batch policy on the same flows; none may differ."""
    rows, batch = stream_decisions(spark, sf)
    name = F.element_at(F.array(*[F.lit(v) for v in ("commit", "reject", "forced_commit", "forced_reject")]), F.col("decision") + 1)
    a = rows.where("kind = 'decision'").select("flow_id", F.struct("k", "decision", "prediction").alias("s"))
    b = batch.select("flow_id", F.struct("k", name.alias("decision"), "prediction").alias("t"))
    return a.join(b, "flow_id", "full_outer").agg(
        F.count("*").alias("flows"), F.count(F.when(~F.col("s").eqNullSafe(F.col("t")), 1)).alias("different")
    )


@query("stream_decision_trace")
def stream_decision_trace(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = stream_decisions(spark, sf, 2)
    return rows.where("kind = 'trace'").select("flow_id", "k", F.round("p_safe", 6).alias("p_safe"), "prediction", "model_version")


@query("stream_prefix_tokens", LONG + f", {TOKENS_SQL} SELECT * FROM tk")
def stream_prefix_tokens(spark: SparkSession, sf: str) -> DataFrame:
    flows = cut(ev_long_flows(spark, sf).select("flow_id", "label", "ppi", "start_us"))
    stream = event_files(spark, flows)
    return RUN.run_to_table(E.feature_stream(stream), "tokens")


@query(
    "replay_schedule",
    LONG + """, s AS (SELECT f.flow_id, pp.j, (f.start_us - (SELECT min(start_us) FROM fl)) / 1e9::DOUBLE + coalesce(sum(CASE WHEN pp.j > 1 THEN least(pp.ipt / 1000.0::DOUBLE, 0.5::DOUBLE) ELSE 0 END) OVER (PARTITION BY f.flow_id ORDER BY pp.j), 0) AS t FROM fl f JOIN pp ON pp.flow_id = f.flow_id)
SELECT flow_id, j - 1 AS index, round(t, 4) AS due_s FROM s""",
)
def replay_schedule(spark: SparkSession, sf: str) -> DataFrame:
    flows = RP.capture_starts(ev_long_flows(spark, sf), 1000.0)
    e = RP.schedule(flows).where("index >= 0")
    base = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return e.select("flow_id", "index", F.round((F.unix_micros("event_time") - base) / 1e6 + 2e-7, 4).alias("due_s"))


@query("replay_poisson")
def replay_poisson(spark: SparkSession, sf: str) -> DataFrame:
    flows = RP.poisson_starts(ev_long_flows(spark, sf).select("flow_id", "label", "ppi"), 20.0, 4)
    e = RP.schedule(flows)
    return e.groupBy((F.col("index") < 0).alias("end")).agg(F.count("*").alias("n"), F.max("event_time").alias("last"))


def slices(rows: DataFrame, least: int) -> int:
    """Time slices of at most a million rows: a slice is one file, so files age in time order."""
    return max(least, -(-rows.count() // 1_000_000))


def event_stream(spark: SparkSession, sf: str, batches: int = BATCHES) -> DataFrame:
    e = B.table(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("event_time"))
    path = scratch_path(spark, "plain")
    RP.write_in_order(e, path, F.unix_micros("event_time"), slices(e, batches))
    return RP.read_stream(spark, path, e.schema)


SESSIONS = """g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)"""


@query(
    "session_windows",
    f"WITH {SESSIONS} SELECT user_id, epoch_us(min(ts)) AS start_us, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, s.n",
)
def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    e = B.table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("event_time"))
    return SF.idle_sessions(e, "user_id", "12 hours").select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query(
    "stream_session_windows",
    f"WITH {SESSIONS} SELECT user_id, epoch_us(min(ts)) AS start_us, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, s.n"
    " HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR",
)
def stream_session_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions whose end the watermark has passed when the input is used up."""
    end = B.table(spark, sf, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("m"))
    out = RUN.run_to_table(SF.idle_sessions(event_stream(spark, sf), "user_id", "12 hours", "1 hour"), "sessions")
    safe = out.crossJoin(F.broadcast(end)).where(F.col("end") <= F.col("m") - F.expr("INTERVAL 1 HOUR"))
    return safe.select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query(
    "tumbling_windows",
    "SELECT epoch_us(ts) // 3600000000 * 3600000000 AS start_us, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2",
)
def tumbling_windows(spark: SparkSession, sf: str) -> DataFrame:
    e = B.table(spark, sf, "events").select("event_type", F.col("ts").cast("timestamp").alias("event_time"))
    return SF.time_windows(e, "1 hour", by=("event_type",)).select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query(
    "stream_sliding_windows",
    """WITH w AS (SELECT (epoch_us(ts) // 21600000000 - i) * 21600000000 AS s FROM events, range(0, 4) r(i))
SELECT s AS start_us, CAST(count(*) AS BIGINT) AS n FROM w GROUP BY s HAVING s + 86400000000 <= (SELECT epoch_us(max(ts)) FROM events) - 3600000000""",
)
def stream_sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    end = B.table(spark, sf, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("m"))
    out = RUN.run_to_table(SF.time_windows(event_stream(spark, sf), "1 day", "6 hours", "1 hour"), "sliding")
    safe = out.crossJoin(F.broadcast(end)).where(F.col("end") <= F.col("m") - F.expr("INTERVAL 1 HOUR"))
    return safe.select(F.unix_micros("start").alias("start_us"), "n")


@query(
    "stream_multi_table_sink",
    "SELECT 'purchase' AS tbl, CAST(count(*) FILTER (event_type = 'purchase') AS BIGINT) AS n FROM events UNION ALL SELECT 'other', CAST(count(*) FILTER (event_type <> 'purchase') AS BIGINT) FROM events",
)
def stream_multi_table_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Two tables from one stream; each batch is written twice and still counted once."""
    path = scratch_path(spark, "tables")
    sink = RUN.write_tables(
        {"purchase": lambda b: b.where("event_type = 'purchase'"), "other": lambda b: b.where("event_type <> 'purchase'")}, path
    )

    def twice(batch: DataFrame, batch_id: int) -> None:
        sink(batch, batch_id)
        sink(batch, batch_id)

    RUN.run_batches(event_stream(spark, sf), twice, "tables")
    return C.concat([spark.read.parquet(f"{path}/{t}").agg(F.lit(t).alias("tbl"), F.count("*").alias("n")) for t in ("purchase", "other")])


def decided_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Events as decided flows: K from the amount, rejected on error, class from the user."""
    e = B.table(spark, sf, "events")
    kind = F.col("event_type")
    rows = e.select(
        F.col("event_id").alias("decision_id"), (F.floor(F.col("value")) % 30 + 1).cast("int").alias("k"),
        F.when(kind == "error", F.lit("reject")).when(kind == "view", F.lit("forced_commit")).when(kind == "signup", F.lit("undecidable")).otherwise(F.lit("commit")).alias("decision"),
        F.when(kind == "error", F.lit(-1)).otherwise((F.col("user_id") % 5).cast("int")).alias("prediction"),
        (F.lit(1.0) - F.col("value") / 530.0).alias("p_safe"), (F.col("value") / 77.0).alias("surprise"),
    )
    path = scratch_path(spark, "decided")
    RP.write_in_order(rows, path, F.col("decision_id"), slices(rows, BATCHES))
    return RP.read_stream(spark, path, rows.schema)


DECIDED = """d AS (SELECT event_id, CAST(floor(value) AS BIGINT) % 30 + 1 AS k, CASE event_type WHEN 'error' THEN 'reject' WHEN 'view' THEN 'forced_commit' WHEN 'signup' THEN 'undecidable' ELSE 'commit' END AS decision,
 1.0::DOUBLE - value / 530.0::DOUBLE AS p_safe, value / 77.0::DOUBLE AS surprise FROM events),
w AS (SELECT *, (row_number() OVER (ORDER BY event_id) - 1) // 200 AS window_id, count(*) OVER () AS total FROM d WHERE decision <> 'undecidable')"""


@query(
    "stream_budget_loop",
    f"WITH {DECIDED} SELECT CAST(window_id AS BIGINT) AS window_id, CAST(count(*) AS BIGINT) AS n, round(avg(k), 6) AS observed, round((avg(k) - 12.0::DOUBLE) / 12.0::DOUBLE, 6) AS error FROM w GROUP BY window_id HAVING count(*) = 200",
)
def stream_budget_loop(spark: SparkSession, sf: str) -> DataFrame:
    loop = L.BudgetLoop(200, 5, ["decision_id"], loop=Loop(12.0))
    RUN.run_batches(decided_stream(spark, sf), loop, "budget")
    return loop.table(spark).select("window_id", "n", F.round("observed", 6).alias("observed"), F.round("error", 6).alias("error"))


@query(
    "stream_drift_loop",
    f"""WITH {DECIDED}, s AS (SELECT window_id, avg(k) AS mean_k, avg(CASE WHEN decision = 'commit' THEN 1.0::DOUBLE ELSE 0 END) AS commit_rate, avg(p_safe) FILTER (decision IN ('commit', 'forced_commit')) AS mean_safe_at_commit, avg(surprise) AS mean_pkt_nll FROM w GROUP BY window_id HAVING count(*) = 200)
SELECT CAST(window_id AS BIGINT) AS window_id, 'mean_k' AS signal, round(mean_k, 6) AS value, round((mean_k - 12.0::DOUBLE) / 2.0::DOUBLE, 6) AS z FROM s
UNION ALL SELECT CAST(window_id AS BIGINT), 'commit_rate', round(commit_rate, 6), round((commit_rate - 0.5::DOUBLE) / 0.05::DOUBLE, 6) FROM s
UNION ALL SELECT CAST(window_id AS BIGINT), 'mean_safe_at_commit', round(mean_safe_at_commit, 6), round((mean_safe_at_commit - 0.9::DOUBLE) / 0.01::DOUBLE, 6) FROM s
UNION ALL SELECT CAST(window_id AS BIGINT), 'mean_pkt_nll', round(mean_pkt_nll, 6), round((mean_pkt_nll - 0.5::DOUBLE) / 0.1::DOUBLE, 6) FROM s""",
)
def stream_drift_loop(spark: SparkSession, sf: str) -> DataFrame:
    ref = {"mean_k": (12.0, 2.0), "commit_rate": (0.5, 0.05), "mean_safe_at_commit": (0.9, 0.01), "mean_pkt_nll": (0.5, 0.1)}
    loop = L.DriftLoop(200, 5, ["decision_id"], histogram=[1.0] * 5)
    RUN.run_batches(decided_stream(spark, sf), loop, "drift")
    return loop.monitored(spark, ref).select("window_id", "signal", F.round("value", 6).alias("value"), F.round("z", 6).alias("z"))
