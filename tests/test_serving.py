"""Stored decisions against the operators over the same rows."""

from __future__ import annotations

import random

import pytest

from flowtide.operators import serving as V
from flowtide.sources.decision_store import DecisionStore

SCHEMA = (
    "flow_id long, decision_id long, k int, decided_at double, decision string, forced boolean, correct boolean,"
    " time_to_decision_ms double, theta_commit double, day string"
)


def made(n, seed, start=1000 * 86400.0):
    r = random.Random(seed)
    kinds = ["commit", "reject", "forced_commit", "forced_reject", "undecidable", None]
    return [
        (i, i, r.choice([0, 1, 5, 30, None]), start + r.randrange(0, 3 * 86400 * 4) / 4, r.choice(kinds), r.choice([True, False, None]),
         r.choice([True, False, None]), r.choice([1.5, 20.0, None]), r.choice([0.5, 0.75, None]), "a clashing name")
        for i in range(n)
    ]


def rows_of(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def test_stored_answers_equal_those_over_all_rows(spark, tmp_path):
    # rows without a time, one moment with many rows, a row on the edge of a day and of a minute
    rows = made(400, 1) + [(900 + i, 900 + i, 3, 1001 * 86400.0, "commit", False, True, 1.0, 0.5, None) for i in range(50)]
    rows += [(990, 990, 4, None, "commit", False, True, 1.0, 0.5, None), (991, 991, 4, 1001 * 86400.0 + 60.0, "reject", True, False, 1.0, 0.5, None)]
    d = spark.createDataFrame(rows, SCHEMA)
    store = DecisionStore(spark, f"{tmp_path}/store")
    store.write(d.where("decision_id % 2 = 0"), 0)
    store.write(d.where("decision_id % 2 = 1"), 1)
    store.write(d.where("decision_id % 2 = 1"), 1)  # a batch written again replaces itself
    now = 1003 * 86400.0
    for window in (86400.0, 2 * 86400.0, 2 * 86400.0 + 0.25, 100_000.75, 59.5, 0.25, 1e7):
        assert rows_of(store.rolling_stats(window, now)) == rows_of(V.rolling_stats(d, window, now)), window
    for bucket, since in ((3600.0, None), (60.0, now - 100_000.75), (7200.0, now - 86400.0), (90.0, now - 5000.25)):
        timed = d.where("decided_at is not null")
        assert rows_of(store.series(bucket, since)) == rows_of(V.series(timed, bucket, since)), (bucket, since)
    for rejected in (False, True):
        assert rows_of(store.k_histogram(rejected, now - 100_000.75)) == rows_of(V.k_histogram(d, rejected, now - 100_000.75))
    assert store.decisions(now - 86400.0).count() == d.where(f"decided_at >= {now - 86400.0}").count()


@pytest.mark.parametrize("since", [1002 * 86400.0 + 30.5, 1002 * 86400.0])
def test_a_window_reads_its_days_only(spark, tmp_path, since):
    store = DecisionStore(spark, f"{tmp_path}/store")
    store.write(spark.createDataFrame(made(100, 2), SCHEMA))
    for df in (store.rolling_stats(1003 * 86400.0 - since, 1003 * 86400.0), store.series(3600.0, since), store.k_histogram(since=since), store.decisions(since)):
        plan = df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
        assert scans and all("PartitionFilters: [isnotnull(day" in line and ">= 1002" in line for line in scans)


def test_an_empty_store_answers(spark, tmp_path):
    store = DecisionStore(spark, f"{tmp_path}/store")
    store.write(spark.createDataFrame(made(3, 3), SCHEMA))
    got = store.rolling_stats(10.0, 2000 * 86400.0).first()
    assert (got["n"], got["undecidable"], got["flows_per_s"], got["mean_k"]) == (0, 0, 0.0, None)
