from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtide import schema as S
from flowtide.functions import ppi as P
from flowtide.operators import damage as G
from flowtide.operators import features as X

PPI = "array<struct<ipt:int,dir:int,size:int,push:int>>"


@pytest.fixture(scope="module")
def flows(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        n = int(rng.integers(1, 31))
        ppi = [(0 if j == 0 else int(rng.integers(0, 5000)), int(rng.choice([-1, 1])), int(rng.integers(1, 1501)), int(rng.integers(0, 2))) for j in range(n)]
        rows.append((i, int(i % 5), ppi, n))
    return spark.createDataFrame(rows, f"flow_id bigint, label int, ppi {PPI}, ppi_len int").cache()


def test_tokens_match_the_edge_rule_for_every_value(spark):
    for n, top in ((S.SIZE_TOKENS, S.SIZE_MAX), (S.IPT_TOKENS, S.IPT_MAX)):
        got = spark.range(top + 1).select(P.log_token(F.col("id"), n, top).alias("t")).orderBy("id").toPandas()["t"].to_numpy()
        edges = np.geomspace(1, top, n + 1)[1:-1]
        assert (got == np.searchsorted(edges, np.arange(top + 1), side="left") + 1).all()


def test_prefix_statistics_against_plain_python(flows):
    got = {r["flow_id"]: r for r in X.prefix_flowstats(flows, 8).collect()}
    for f in flows.collect():
        p = f["ppi"][:8]
        r = got[f["flow_id"]]
        assert r["bytes"] == sum(q["size"] for q in p if q["dir"] == 1)
        assert r["packets_rev"] == sum(q["dir"] == -1 for q in p)
        assert r["ppi_roundtrips"] == sum(a["dir"] != b["dir"] for a, b in zip(p, p[1:], strict=False)) // 2
        h = np.bincount(np.searchsorted(S.SIZE_EDGES, [q["size"] for q in p if q["dir"] == 1], side="left"), minlength=8)
        assert [r[f"psize_hist_{i}"] for i in range(8)] == h.tolist()
        assert r["flag_psh"] == float(any(q["push"] for q in p)) and r["flag_ack"] == 0


def test_prefixes_grow_and_do_not_look_ahead(flows):
    grid = X.prefix_grid(flows).groupBy("flow_id").agg(F.array_sort(F.collect_list(F.struct("k", "bytes", "ppi_duration"))).alias("g"))
    for r in grid.collect():
        assert all(a["bytes"] <= b["bytes"] and a["ppi_duration"] <= b["ppi_duration"] for a, b in zip(r["g"], r["g"][1:], strict=False))
    a = X.prefix_flowstats(flows, 5)
    b = X.prefix_flowstats(X.cut_prefix(flows, 5), 30)
    assert a.exceptAll(b).isEmpty()


def test_one_pass_gives_what_each_prefix_gives(flows):
    ks = [1, 2, 7, 30]
    grid = X.prefix_grid(flows, ks)
    for k in ks:
        own, alone = grid.where(F.col("k") == k).drop("k"), X.prefix_flowstats(flows, k)
        assert own.columns == alone.columns and own.schema.simpleString() == alone.schema.simpleString()
        assert own.exceptAll(alone).isEmpty() and own.count() == alone.count()


@pytest.mark.parametrize("k", [0, 31, True, 2.0])
def test_bad_k_raises(flows, k):
    with pytest.raises(ValueError):
        X.prefix_flowstats(flows, k)


def test_standardised_training_data_has_mean_zero_and_padding_stays_zero(flows):
    fit = X.fit_continuous(flows).withColumn("view", F.lit("continuous"))
    rows = X.transform_continuous(flows, fit, ["flow_id", "ppi_len"]).select("ppi_len", F.posexplode("cont").alias("j", "c"))
    real = rows.where("j < ppi_len").agg(F.avg("c.log_ipt").alias("m"), F.stddev_pop("c.log_ipt").alias("s")).first()
    assert real["m"] == pytest.approx(0, abs=1e-9) and real["s"] == pytest.approx(1)
    assert rows.where("j >= ppi_len and (c.size_dir <> 0 or c.dir <> 0)").isEmpty()


def test_training_frame_refuses_unknown_labels(flows):
    fit = X.fit_continuous(flows).withColumn("view", F.lit("continuous"))
    bad = flows.withColumn("label", F.lit(-1))
    with pytest.raises(Exception, match="unknown label"):
        X.training_frame(bad, fit, train=True).collect()


def draws(flows):
    return G.hash_draw(3, F.col("flow_id"))


def test_drop_keeps_time_and_at_least_one_packet(flows):
    out = flows.select("ppi", G.drop(F.col("ppi"), 0.7, draws(flows)).alias("d"), G.drop(F.col("ppi"), 1.0, draws(flows)).alias("one"))
    for r in out.collect():
        assert 1 <= len(r["d"]) <= len(r["ppi"]) and r["d"][0]["ipt"] == 0 and len(r["one"]) == 1
    same = flows.select("ppi", G.drop(F.col("ppi"), 0.0, draws(flows)).alias("d")).collect()
    assert all(r["ppi"] == r["d"] for r in same)


def test_swap_keeps_the_packets(flows):
    for q in (0.4, 1.0):
        for r in flows.select("ppi", G.swap_neighbours(F.col("ppi"), q, draws(flows)).alias("s")).collect():
            key = lambda p: (p["dir"], p["size"], p["push"])
            assert sorted(map(key, r["ppi"])) == sorted(map(key, r["s"])) and r["s"][0]["ipt"] == 0
            if q == 1.0 and len(r["ppi"]) > 1:
                assert key(r["s"][0]) == key(r["ppi"][1])


def test_jitter_stays_in_range_and_crop_is_shorter(flows):
    d = draws(flows)
    k, ok = G.prefix_crop(F.col("ppi_len"), d)
    out = flows.select("ppi_len", G.jitter_sizes(F.col("ppi"), 500.0, d).alias("s"), G.jitter_gaps(F.col("ppi"), 2.0, d).alias("g"), k.alias("k"), ok.alias("ok"))
    for r in out.collect():
        assert all(1 <= p["size"] <= 1500 for p in r["s"]) and all(0 <= p["ipt"] <= S.IPT_MAX for p in r["g"])
        assert (3 <= r["k"] < r["ppi_len"]) if r["ok"] else r["k"] == r["ppi_len"]


def test_draws_do_not_depend_on_partitions(flows):
    a = flows.select("flow_id", G.drop(F.col("ppi"), 0.3, draws(flows)).alias("d"))
    b = flows.repartition(7).select("flow_id", G.drop(F.col("ppi"), 0.3, draws(flows)).alias("d"))
    assert a.exceptAll(b).isEmpty()


def test_conditions_are_checked():
    assert list(G.conditions([{"name": "x", "kind": "drop", "value": 0.1}, G.UNDAMAGED])) == ["clean", "x"]
    twice = {"name": "x", "kind": "drop", "value": 0.1}
    with pytest.raises(ValueError):
        G.conditions([twice, twice])
    for bad in ({"name": "x", "kind": "melt", "value": 1}, {"name": "x", "kind": "drop"}, {"name": "x", "kind": "drop", "value": 2.0}, {"name": "clean", "kind": "drop", "value": 0.1}):
        with pytest.raises(ValueError):
            G.conditions([bad])
