from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtide import bindings as B
from flowtide import schema as S
from flowtide.operators import assemble as A
from flowtide.operators import scores as C
from flowtide.session import scratch_path
from flowtide.streaming import engine as E
from flowtide.streaming import flows as SF
from flowtide.streaming import replay as RP
from flowtide.streaming import run as RUN


def model(version="m1", flip=False):
    centers = np.zeros((2, 60))
    centers[0 if flip else 1] = 3.0
    return C.ScoreModel(C.CentroidScorer(centers, 0.1, version))


def stream(spark, batches):
    """batches: lists of (flow, index, second, size)."""
    path = scratch_path(spark, "t")
    t0 = dt.datetime(2024, 1, 1)
    for rows in batches:
        data = [(f, i, t0 + dt.timedelta(seconds=s), None if i < 0 else 5, None if i < 0 else 1, None if i < 0 else z, None if i < 0 else 0, 0) for f, i, s, z in rows]
        spark.createDataFrame(data, RP.EVENTS).coalesce(1).write.mode("append").parquet(path)
    return RP.read_stream(spark, path, RP.EVENTS)


def run(spark, batches, rules, versions=None, watermark="0 seconds"):
    return RUN.run_to_table(E.decide_stream(stream(spark, batches), versions or [E.Version(model())], rules, watermark), "t").collect()


def test_rules_of_the_engine(spark):
    never = E.Rules(theta_commit=0.9999, idle_s=60.0)
    rows = run(
        spark,
        [
            # 1: a duplicate and a gap are ignored; 2: no payload; 3: no end marker
            [(1, 0, 0, 20), (1, 0, 0, 20), (1, 2, 1, 20), (2, -1, 1, 0), (3, 0, 1, 20)],
            [(1, 1, 2, 20), (1, -1, 3, 0)],
            # a late event of a decided flow, and time goes on so flow 3 expires
            [(1, 2, 10, 20), (4, 0, 200, 20), (4, 1, 201, 20)],
            [(4, -1, 400, 0)],
        ],
        never,
    )
    got = {r["flow_id"]: r for r in rows if r["kind"] == "decision"}
    assert (got[1]["k"], got[1]["decision"], got[1]["ignored"]) == (2, "forced_commit", 2)
    assert (got[2]["k"], got[2]["decision"]) == (0, E.UNDECIDABLE)
    assert (got[3]["k"], got[3]["decision"]) == (1, "forced_commit")
    assert got[4]["k"] == 2 and len(rows) == 4


def test_thirty_packets_force_a_decision_and_more_are_ignored(spark):
    batch = [(1, i, i, 20) for i in range(35)]
    (r,) = run(spark, [batch], E.Rules(theta_commit=2.0))
    assert (r["k"], r["decision"]) == (30, "forced_commit")


def test_a_flow_keeps_the_model_it_started_with(spark):
    switch = int(dt.datetime(2024, 1, 1, 0, 0, 5, tzinfo=dt.UTC).timestamp() * 1000)
    versions = [E.Version(model("old")), E.Version(model("new", True), since_ms=switch)]
    rows = run(
        spark, [[(1, 0, 0, 900)], [(1, 1, 8, 900), (2, 0, 9, 900), (1, -1, 9, 0), (2, -1, 10, 0)]], E.Rules(theta_commit=2.0), versions
    )
    assert {r["flow_id"]: r["model_version"] for r in rows} == {1: "old", 2: "new"}


@pytest.mark.parametrize("batches", [1, 4])
@pytest.mark.parametrize("timers", [False, True])
def test_streamed_flows_are_the_batch_flows(spark, sf, batches, timers):
    base = B.ev_packets(spark, sf)
    packets = A.with_side(base).withColumn("event_time", F.timestamp_micros("ts_us"))
    path = scratch_path(spark, "p")
    RP.write_in_order(SF.with_flush(packets), path, F.col("ts_us"), batches, "flow_key")
    out = RUN.run_to_table(SF.flow_stream(RP.read_stream(spark, path, SF.PACKETS), B.EV_TIMEOUTS, timers), "f")
    cols = ["flow_key", "flow_id", "start_us", "end_us", "packets", "bytes_rev", "flags_seen", "ppi"]
    want = A.assemble(base, B.EV_TIMEOUTS).select(*cols)
    assert out.select(*cols).exceptAll(want).isEmpty() and out.count() == want.count()


def test_a_hot_key_in_the_stream_is_merged_from_sorted_runs(spark, sf):
    base = B.ev_packets(spark, sf).withColumn("flow_key", F.lit(1).cast("long"))
    packets = A.with_side(base).withColumn("event_time", F.timestamp_micros("ts_us")).withColumn("flow_key", F.lit(1).cast("long"))
    path = scratch_path(spark, "p")
    SF.with_flush(packets).repartition(3, "pkt_id").coalesce(1).write.parquet(path)
    flows = [RUN.run_to_table(SF.flow_stream(RP.read_stream(spark, path, SF.PACKETS), B.EV_TIMEOUTS, False, held=h, piece=p), "f") for h, p in ((10**6, 1000), (30, 7))]
    # 30 rows at a time are more runs than are merged at once
    assert packets.count() > 30 * SF.FAN_IN and flows[0].count() > 1
    assert flows[0].exceptAll(flows[1]).isEmpty() and flows[0].count() == flows[1].count()
    assert flows[1].agg(F.sum(F.col("packets") + F.col("packets_rev"))).first()[0] == packets.count()


def test_the_rule_matches_the_column_form(spark):
    from flowtide.operators import policies as H

    cases = [(k, p, u, th) for k in (1, 2, 3, 5) for p in (0.2, 0.8, float("nan")) for u in (0.0, 2.0, float("nan")) for th in (1.0, None)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, k int, p double, u double, th double")
    for order in H.ORDERS:
        rules = E.Rules(theta_commit=0.5, order=order)
        got = df.select("i", H.decide(F.col("k"), F.col("p"), F.col("u"), F.lit(7), F.lit(0.5), F.col("th"), F.lit(5), order=order).alias("d")).orderBy("i").collect()
        for (k, p, u, th), r in zip(cases, got, strict=True):
            want = E.rule(k, p, u, 7, th, 5, rules)
            assert (tuple(r["d"]) if r["d"] else None) == want


def test_listeners_are_isolated(spark):
    seen, errors = [], []

    def broken(batch, i):
        raise RuntimeError("no")

    RUN.isolated([broken, lambda b, i: seen.append(i)], errors)(None, 3)
    assert seen == [3] and len(errors) == 1


def test_schedule_paces_gaps(spark):
    ppi = "array<struct<ipt:int,dir:int,size:int,push:int>>"
    df = spark.createDataFrame([(1, 0, [(0, 1, 5, 0), (100, 1, 5, 0), (9000, 1, 5, 0)], 0.0), (2, 0, [], 1.0)], f"flow_id bigint, label int, ppi {ppi}, start_s double")
    rows = RP.schedule(df).orderBy("flow_id", "event_time").collect()
    at = [(r["flow_id"], r["index"], round(r["event_time"].timestamp() % 60, 3)) for r in rows]
    assert at == [(1, 0, 0.0), (1, 1, 0.1), (1, 2, 0.6), (1, -1, 0.65), (2, -1, 1.05)]
    with pytest.raises(ValueError):
        RP.schedule(df, speed=0)
    assert S.K_MAX == 30


def decided(spark, start, n):
    rows = [(i, i % 7 + 1, "commit", 0.9, 0.5, 0) for i in range(start, start + n)]
    return spark.createDataFrame(rows, "decision_id long, k int, decision string, p_safe double, surprise double, prediction int")


def test_a_change_of_mode_starts_a_full_window_and_a_restart_goes_on(spark, tmp_path):
    from flowtide.operators.budget import Loop
    from flowtide.streaming.loops import BudgetLoop

    make = lambda: BudgetLoop(10, 3, ["decision_id"], f"{tmp_path}/loop", loop=Loop(4.0, least_flows=5))
    loop = make().resume(spark)
    loop(decided(spark, 0, 13), 0)
    loop.set_mode("manual", 0.7)
    loop(decided(spark, 13, 14), 1)
    judged = lambda x: x.table(spark).orderBy("window_id").collect()
    assert [(r["window_id"], r["n"], r["mode"]) for r in judged(loop)] == [(0, 10, "auto"), (1, 10, "manual")] and loop.open["n"] == 4
    again = make().resume(spark)
    assert again.state == loop.state and judged(again) == judged(loop) and again.open == loop.open
    again(decided(spark, 13, 14), 1)  # a batch that was stored is not judged again
    again(decided(spark, 27, 6), 2)
    assert [(r["window_id"], r["n"]) for r in judged(again)] == [(0, 10), (1, 10), (2, 10)] and again.theta == 0.7
    again.set_budget(target=5.0, window=12)
    again(decided(spark, 33, 12), 3)
    last = judged(again)[-1]
    assert last["n"] == 12 and last["target"] == 5.0 and again.table(spark).count() == 4


def test_settings_changed_between_batches_survive_a_restart(spark, tmp_path):
    from flowtide.operators.budget import Loop
    from flowtide.streaming.loops import BudgetLoop, DriftLoop

    make = lambda: BudgetLoop(10, 3, ["decision_id"], f"{tmp_path}/loop", loop=Loop(4.0, least_flows=5))
    first = make()
    first.set_mode("quality_first")  # before any batch
    assert make().resume(spark).state["mode"] == "quality_first"
    first(decided(spark, 0, 13), 0)
    first.set_budget(window=12)
    first.set_budget(follow="p95_k", target=6.0)
    first.set_mode("auto")
    again = make().resume(spark)
    assert (again.window, again.loop.follow, again.loop.target, again.state) == (12, "p95_k", 6.0, first.state) and again.open == {}
    again(decided(spark, 13, 12), 1)
    rows = again.table(spark).orderBy("window_id").collect()
    assert [(r["n"], r["metric"], r["target"], r["mode"]) for r in rows] == [(10, "mean_k", 4.0, "quality_first"), (12, "p95_k", 6.0, "auto")]
    assert again.rows == []  # what a loop holds does not grow with the stream
    drift = DriftLoop(10, 1, ["decision_id"], f"{tmp_path}/drift", histogram=[1.0])
    drift(decided(spark, 0, 25), 0)
    assert drift.table(spark).count() == 2 and drift.table(spark).columns[0] == "window_id"
