from __future__ import annotations


import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtide import schema as S
from flowtide.operators import budget as U
from flowtide.operators import calibrate as K
from flowtide.operators import drift as D
from flowtide.operators import evaluate as V
from flowtide.operators import metrics as M
from flowtide.operators import policies as H
from flowtide.operators import scores as C
from flowtide.operators.ordered import average_ranks, exact_quantiles, global_row_number

N = 120


def arrays(seed=0):
    rng = np.random.default_rng(seed)
    length = rng.integers(1, 31, N)
    speed = rng.uniform(0.05, 0.4, N)
    k = np.arange(1, 31)[None]
    p = np.clip(1 - np.exp(-k * speed[:, None]) + rng.normal(0, 0.03, (N, 30)), 0, 1).round(3)
    label = np.where(rng.random(N) < 0.2, -1, rng.integers(0, 4, N))
    pred = np.where(rng.random((N, 30)) < p, np.maximum(label, 0)[:, None], rng.integers(0, 4, (N, 30)))
    u = (rng.normal(0, 1, (N, 30)) + 2.0 * (label < 0)[:, None]).round(3)
    margin = (p * 0.8).round(3)
    return length, label, p, pred, u, margin


@pytest.fixture(scope="module")
def scores(spark):
    length, label, p, pred, u, margin = arrays()
    rows = [
        (i, int(label[i]), i // 40, int(length[i]), *[list(map(float, a[i])) for a in (p, p, margin, u)], list(map(int, pred[i])), list(map(float, -p[i])))
        for i in range(N)
    ]
    return spark.createDataFrame(
        rows,
        "flow_id bigint, label int, period int, ppi_len int, p_safe array<double>, conf array<double>, margin array<double>, u array<double>, pred array<int>, energy_raw array<double>",
    ).cache()


def plain_safe_stop(theta, th, order, k_cap=30):
    length, _, p, pred, u, _ = arrays()
    out = []
    for i in range(N):
        last = min(int(length[i]), k_cap)
        for k in range(1, last + 1):
            rej = k >= 3 and th is not None and u[i, k - 1] >= th
            com = k >= 2 and p[i, k - 1] >= theta
            if order == "reject_first" and rej or (rej and not com):
                out.append((k, S.REJECT, -1))
                break
            if com:
                out.append((k, S.COMMIT, int(pred[i, k - 1])))
                break
            if k == last:
                over = th is not None and u[i, k - 1] >= th
                out.append((k, S.FORCED_REJECT, -1) if over else (k, S.FORCED_COMMIT, int(pred[i, k - 1])))
    return out


@pytest.mark.parametrize("order", H.ORDERS)
@pytest.mark.parametrize("th", [None, 1.5])
def test_safe_stop_against_a_plain_loop(scores, order, th):
    d = H.safe_stop(scores, 0.7, [th] * 30, order=order).orderBy("flow_id").collect()
    assert [(r["k"], r["decision"], r["prediction"]) for r in d] == plain_safe_stop(0.7, th, order)


def test_missing_scores_commit_never_and_reject_always(spark):
    nan = float("nan")
    row = (1, 0, 0, 5, [nan] * 30, [nan] * 30, [1] * 30)
    s = spark.createDataFrame([row], "flow_id bigint, label int, period int, ppi_len int, p_safe array<double>, u array<double>, pred array<int>")
    a = H.safe_stop(s, 0.5, [9.0] * 30).first()
    assert (a["k"], a["decision"], a["n_nan"]) == (3, S.REJECT, 2)
    b = H.safe_stop(s, 0.5).first()
    assert (b["k"], b["decision"]) == (5, S.FORCED_COMMIT)


@pytest.mark.parametrize("order", H.ORDERS)
def test_sweep_equals_replaying_every_threshold(scores, order):
    grid = [0.1, 0.35, 0.6, 0.9, 0.999]
    th = [1.5] * 30
    got = {round(r["theta"], 6): r for r in H.sweep(scores, "p_safe", grid, k_min=2, theta_reject=th, order=order).collect()}
    for t in grid:
        want = H.summarize(H.safe_stop(scores, t, th, order=order)).first()
        for a, b in (("mean_k", "mean_k"), ("accuracy", "known_accuracy"), ("known_reject_rate", "known_reject_rate"), ("p95_k", "p95_k"), ("forced_rate", "forced_rate")):
            assert got[t][a] == pytest.approx(want[b]), (t, a)


def test_calibrated_threshold_meets_its_target(scores):
    for target in (4.0, 6.0):
        fit = H.calibrate_theta(scores.drop("u"), target)
        achieved = H.safe_stop(scores.drop("u"), fit["theta"]).agg(F.avg("k")).first()[0]
        assert achieved == pytest.approx(fit["mean_k"])
        assert abs(achieved - target) < 0.3


def test_auroc_and_precision_against_definitions(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(0, 1, 300).round(1), rng.random(300) < 0.3
    df = spark.createDataFrame([(i, float(a), bool(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "flow_id bigint, s double, y boolean")
    pos, neg = x[y], x[~y]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert M.auroc(df, "s", F.col("y")).first()["auroc"] == pytest.approx(want)
    o = np.argsort(-x, kind="stable")
    tp = np.cumsum(y[o])
    ap = (tp / np.arange(1, 301))[y[o]].mean()
    assert M.average_precision(df, "s", F.col("y")).first()["aupr"] == pytest.approx(ap)
    hit = np.flatnonzero(tp / y.sum() >= 0.9)[0]
    assert M.fpr_at_tpr(df, "s", F.col("y"), 0.9).first()["fpr"] == pytest.approx((hit + 1 - tp[hit]) / (~y).sum())
    one = df.where("y")
    assert M.auroc(one, "s", F.col("y")).first()["auroc"] is None


def test_quantiles_are_numpys(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, 257).round(1)
    df = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(x)], "g int, v double")
    probs = [0.0, 0.02, 0.5, 0.973, 1.0]
    for r in exact_quantiles(df, ["g"], "v", probs).collect():
        assert r["quantile"] == pytest.approx(np.quantile(x[r["g"] :: 2], r["prob"]))


def test_row_numbers_are_global(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("a"), "id")
    got = [r["id"] for r in global_row_number(df, ["a", "id"]).orderBy("rn").collect()]
    assert got == sorted(range(1000), key=lambda v: (v % 7, v))


def test_per_class_scores_by_hand(spark):
    rows = [(0, 0)] * 3 + [(0, 1)] + [(1, 1)] * 2 + [(1, 2)]
    df = spark.createDataFrame(rows, "label int, pred int")
    got = {r["c"]: r for r in M.per_class(df).collect()}
    assert got[0]["precision"] == 1 and got[0]["recall"] == 0.75
    # a prediction outside the listed classes leaves the matrix
    assert got[1]["support"] == 2 and got[1]["recall"] == 1 and set(got) == {0, 1}


def test_spearman_needs_three_pairs_and_spread(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0)], "x double, y double")
    assert M.spearman(df, "x", "y").first()["spearman"] is None
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (2.0, 9.0), (5.0, 11.0)], "x double, y double")
    rx, ry = [1, 2.5, 2.5, 4], [1, 2, 3, 4]
    assert M.spearman(df, "x", "y").first()["spearman"] == pytest.approx(np.corrcoef(rx, ry)[0, 1])


def test_ties_share_a_rank_across_partitions(spark):
    rng = np.random.default_rng(3)
    values = np.where(rng.random(3000) < 0.5, 4.0, rng.integers(0, 9, 3000)).astype(float)
    rows = [(int(i), "a" if i % 3 else None, float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, g string, v double").repartition(5, "i")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r["i"]: r["r"] for r in average_ranks(df, ["g"], "v", "r").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(got) == 3000
    for own in ([i for i, g, _ in rows if g is None], [i for i, g, _ in rows if g == "a"]):
        x = values[own]
        want = [(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x]
        assert [got[i] for i in own] == want
    assert average_ranks(df.limit(0), ["g"], "v", "r").isEmpty()


def test_the_table_hash_sees_the_last_bit_and_no_order(spark):
    kinds = "a long, x double, v array<double>, t struct<p:string,q:float>"
    rows = [(1, 0.1, [1e300, -2.5], ("a", 0.5)), (2, float("nan"), [], None), (None, None, None, (None, None)), (3, float("-inf"), [5e-324], ("-", -0.0)), (3, 2.0**1023, [None], ("", 1.0))]
    one = lambda r: tuple(C.content_hash(spark.createDataFrame(r, kinds)).first())
    base = one(rows)
    assert base[0] == 5 and one(rows[::-1]) == base
    assert tuple(C.content_hash(spark.createDataFrame(rows, kinds).repartition(3).select("t", "v", "x", "a")).first()) == base
    changed = [
        [(1, float(np.nextafter(0.1, 1)), *rows[0][2:]), *rows[1:]], [(1, -0.1, *rows[0][2:]), *rows[1:]], [(1, 0.1, [-2.5, 1e300], rows[0][3]), *rows[1:]],
        [*rows[:3], (3, float("-inf"), [1e-323], rows[3][3]), rows[4]], [*rows, rows[0], rows[0]], [rows[0], (2, rows[1][1], [], (None, None)), *rows[2:]],
    ]
    assert len({base, *map(one, changed)}) == 1 + len(changed)
    texts = spark.createDataFrame([(v,) for v in (1.0, -0.75, 2.0**-1074, 2.0**-1022, np.finfo(float).max.item(), 3.0)], "x double")
    for r in texts.select("x", C.exact_text(F.col("x")).alias("t")).collect():
        whole, power = r["t"].split("p")
        assert r["x"] == int(whole) * 2.0 ** (int(power) - 52) if int(power) > -1000 else r["x"] == int(whole) * 2.0**-1074
    assert one([]) == (0, 0, 0)


def pav(x, y):
    xs = sorted(set(x))
    blocks = []
    for v in xs:
        ys = [b for a, b in zip(x, y, strict=True) if a == v]
        blocks.append([sum(ys), len(ys), [v]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] > blocks[-1][0] / blocks[-1][1]:
            s, n, vs = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + vs]
    return {v: s / n for s, n, vs in blocks for v in vs}


def test_isotonic_map_is_pool_adjacent_violators(spark):
    rng = np.random.default_rng(4)
    x = rng.random(300).round(2)
    y = (rng.random(300) < x).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    m = K.fit_isotonic(df)
    want = pav(x.tolist(), y.tolist())
    got = df.select("x", m.of(F.col("x")).alias("p")).distinct().collect()
    assert all(r["p"] == pytest.approx(want[r["x"]]) for r in got)


def test_isotonic_maps_of_groups_in_many_ranges(spark):
    rng = np.random.default_rng(6)
    rows = [(g, float(v), float(rng.random() < v)) for g, n in ((3, 40), (7, 900), (9, 1)) for v in rng.random(n).round(3)]
    # a falling tail pools back over everything before it
    rows += [(5, i / 100, i / 100) for i in range(100)] + [(5, 2.0, -1e4)]
    gone = [(None, 0.1, 1.0), (7, None, 1.0), (7, 0.1, None), (7, float("nan"), 1.0)]
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        maps = K.fit_isotonics(spark.createDataFrame(rows + gone, "k int, x double, y double"), "k")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert sorted(maps) == [3, 5, 7, 9]
    for g, m in maps.items():
        want = pav([r[1] for r in rows if r[0] == g], [r[2] for r in rows if r[0] == g])
        assert np.interp(sorted(want), m.xs, m.ys) == pytest.approx([want[v] for v in sorted(want)])
    assert len(maps[5].xs) == 2 and maps[9].xs == [rows[940][1]]
    cal = K.Calibration("a", [], [], {**maps, 1: K.Constant(0.25), 2: K.Line(2.0, -1.0)})
    asked = [(k, c, "kept") for k in (1, 2, 3, 4, 7, 9) for c in (-1.0, 0.0, 0.123, 0.5, 0.777, 2.0, None)]
    got = cal.with_probability(spark.createDataFrame(asked, "k int, conf double, kind string")).collect()
    assert len(got) == len(asked) and {r["kind"] for r in got} == {"kept"}
    for r in got:
        k, c = r["k"], r["conf"]
        if k == 1:
            assert r["p_correct"] == 0.25
        elif k == 4 or c is None:
            assert r["p_correct"] is None
        elif k == 2:
            assert r["p_correct"] == pytest.approx(1 / (1 + np.exp(1 - 2 * c)))
        else:
            assert r["p_correct"] == pytest.approx(np.interp(c, maps[k].xs, maps[k].ys))
    none = spark.createDataFrame([], "x double, y double")
    assert K.fit_isotonic(none) == K.Constant(0.5)


def test_platt_map_recovers_a_line(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, 3000)
    y = rng.random(3000) < 1 / (1 + np.exp(-(2 * x - 0.5)))
    m = K.fit_platt(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double"))
    assert m.slope == pytest.approx(2, abs=0.25) and m.offset == pytest.approx(-0.5, abs=0.2)


def test_map_choice_and_checkpoint(spark):
    rng = np.random.default_rng(8)
    rows = [(k, float(x), float(rng.random() < x)) for k, n in ((1, 40), (2, 30), (4, 120)) for x in rng.random(n)]
    maps = K.fit_maps(spark.createDataFrame(rows, "k int, x double, y double"), range(1, 5), few=100)
    assert [maps[k].kind for k in range(1, 5)] == ["platt", "platt", "constant", "isotonic"]
    alone = K.fit_platt(spark.createDataFrame([r[1:] for r in rows if r[0] == 2], "x double, y double"))
    assert maps[2] == pytest.approx(alone)
    with pytest.raises(ValueError):
        K.Calibration("a", [], [], {}).of("b")


def test_temperature_never_makes_it_worse(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(200):
        y = int(rng.integers(0, 3))
        z = rng.normal(0, 1, 3)
        z[y] += 1
        rows.append((i, y, 1 + i % 2, [float(v * (5 if i % 2 else 1)) for v in z]))
    df = spark.createDataFrame(rows, "flow_id bigint, label int, k int, zk array<double>").cache()
    t = K.fit_temperatures(df)
    before = {r["k"]: r["nll"] for r in K.temperature_grid(df, [1.0]).collect()}
    grid = K.temperature_grid(df, [0.25, 0.5, 1, 2, 4, 8]).groupBy("k").agg(F.min("nll").alias("m")).collect()
    at = {k: K.temperature_grid(df.where(F.col("k") == k), [t[k - 1]]).first()["nll"] for k in (1, 2)}
    assert all(at[k] <= before[k] + 1e-12 for k in at) and all(at[r["k"]] <= r["m"] + 1e-9 for r in grid)
    assert t[1] > 2 * t[0] and t[5] == 1.0


def plain_rl(lam, n_bins, min_count):
    length, label, p, pred, _, margin = arrays()
    known = label >= 0
    last, y, hit = length[known], label[known], (pred == label[:, None])[known].astype(float)
    cell = lambda v: np.minimum((v * n_bins).astype(int), n_bins - 1)
    b = cell(p[known]) * n_bins + cell(margin[known])
    q = {}
    v = np.zeros(len(y))
    for k in range(30, 0, -1):
        alive, go = last >= k, last > k
        for s in np.unique(b[alive, k - 1]):
            m, g = alive & (b[:, k - 1] == s), go & (b[:, k - 1] == s)
            qc = (hit[m, k - 1].mean() if m.sum() >= min_count else hit[alive, k - 1].mean()) - lam * k / 30
            qn = -np.inf if not go.any() else (v[g].mean() if g.sum() >= min_count else v[go].mean())
            q[k, int(s)] = (qc, qn)
        here = np.array([q[k, int(s)] if a else (0.0, -np.inf) for s, a in zip(b[:, k - 1], alive, strict=True)])
        v = np.where(last == k, here[:, 0], here.max(1))
    return q


def test_optimal_stop_against_plain_induction(scores):
    want = plain_rl(0.5, 4, 3)
    got = {(r["k"], r["bin"]): (r["q_commit"], r["q_cont"]) for r in H.fit_optimal_stop(scores, [0.5], n_bins=4, min_count=3).collect() if r["bin"] >= 0}
    assert set(want) <= set(got)
    for key, (qc, qn) in want.items():
        assert got[key][0] == pytest.approx(qc) and (got[key][1] == qn or got[key][1] == pytest.approx(qn)), key


def test_matched_rate_is_reached(scores):
    bank = V.quantile_bank(scores)
    f = V.match_f(scores, bank, 0.25)
    rate = V.rejection_stats(scores, V.theta_at(bank, f), f).first()["known_reject_rate"]
    assert rate == pytest.approx(0.25, abs=0.03)


def window(mean, n=500, p95=9.0, rejects=0.0):
    return {"n": n, "mean_k": mean, "p95_k": p95, "reject_rate": rejects}


def test_a_loop_settles_on_a_plant_and_reports_rails():
    import json

    loop = U.Loop(6.0, U.Dial(0.6, 0.5, 0.999, 1.0, 0.02))
    x = loop.begin()
    for _ in range(60):
        mean = 2.0 + 1.2 * H.logit(x["theta"])
        x, _, _ = loop.step(x, window(mean))
    assert mean == pytest.approx(6.0, rel=0.05)
    low, y, told = U.Loop(0.5), U.Loop(0.5).begin(), []
    for _ in range(12):
        y, what, _ = low.step(y, window(9.0))
        told.append(what)
    assert told.count("infeasible") == 1
    assert loop.step(x, window(9.0, n=10))[:2] == (x, "frozen")
    for wrong in (lambda: U.Loop(-1.0), lambda: U.Loop(6.0, follow="median"), lambda: U.Loop(6.0, U.Dial(0.4, 0.5, 0.9, 1.0, 0.0))):
        with pytest.raises(ValueError):
            wrong()
    assert loop.step(json.loads(json.dumps(x)), window(7.0)) == loop.step(x, window(7.0))


def test_swings_halve_the_gains():
    loop, told = U.Loop(6.0), []
    x = loop.begin()
    for i in range(6):
        x, what, _ = loop.step(x, window(7.0 if i % 2 else 5.0))
        told.append(what)
    assert told[-1].endswith("oscillation") and x["scale"] == 0.5 and not x["errors"]


def test_tail_mode_moves_the_cap_and_a_limit_moves_f():
    loop = U.Loop(8.0, follow="p95_k", reject_limit=0.05)
    x, _, _ = loop.step(loop.begin(), window(5.0, p95=20.0, rejects=0.2))
    assert x["k_cap"] == 29 and x["f"] < loop.reject.start and x["theta"] == loop.commit.start


def test_replay_fast_and_general_paths_agree(scores):
    known = scores.where("label >= 0")
    bank = V.quantile_bank(known)
    stream = U.stream_order([("a", scores.where("period < 2")), ("b", scores.where("period = 2"))])
    dial = U.Dial(0.7, 0.5, 0.999, 0.5, 0.05)
    make = lambda limit: U.Loop(6.0, dial, least_flows=10, reject_limit=limit)
    fast = U.replay(stream, {"x": make(None)}, bank=bank, window=40).orderBy("window_id").collect()
    p95 = U.Loop(6.0, dial, least_flows=10, follow="p95_k")
    slow = U.replay(stream, {"x": make(None), "y": p95}, bank=bank, window=40).where("name = 'x'").orderBy("window_id").collect()
    assert [tuple(r) for r in fast] == [tuple(r) for r in slow]


def test_cusum_alarms_on_a_step_and_resets(spark):
    z = [0.0] * 10 + [2.0] * 12
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(z)], "signal string, window_id bigint, z double")
    got = [r["alarm"] for r in D.cusum(df, 5.0).orderBy("window_id").collect()]
    assert got.index(True) == 13 and got.count(True) == 3
    whole = D.cusum(df, 5.0).orderBy("window_id").collect()
    cut = D.cusum(df.repartition(5), 5.0).orderBy("window_id").collect()
    assert [tuple(r) for r in whole] == [tuple(r) for r in cut]


def test_reference_needs_two_windows_and_h_is_tuned(spark):
    w = spark.createDataFrame([(0, 1.0)], "window_id bigint, a double")
    with pytest.raises(Exception, match="two windows"):
        D.reference_moments(w, ["a"]).collect()
    df = spark.createDataFrame([("s", i, 1.5) for i in range(12)], "signal string, window_id bigint, z double")
    assert D.tune_h(df, warmup=5) == 7.0
    with pytest.raises(ValueError):
        D.tune_h(df, warmup=5, grid=[1.0])


def test_weighted_draw_follows_the_weights(spark):
    rows = spark.range(100).withColumnRenamed("id", "pos").withColumn("w", F.when(F.col("pos") < 10, F.lit(9.0)).otherwise(F.lit(1.0)))
    n = spark.range(4000).withColumnRenamed("id", "draw")
    out = U.weighted_draw(rows, F.col("w"), n, 0, "t")
    assert out.count() == 4000
    assert out.where("pos < 10").count() / 4000 == pytest.approx(0.5, abs=0.04)


def test_gaussian_fit_refuses_unknown_and_matches_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (80, 60))
    y = rng.integers(0, 2, 80)
    df = spark.createDataFrame([(i, int(y[i]), 30, x[i].tolist()) for i in range(80)], "flow_id bigint, label int, ppi_len int, x array<double>")
    four = lambda v: C.em_projection(v, 4)
    bank = C.fit_distances(C.gaussian_sums(df, four), 2, 4, 10)
    p = x[:, :4]
    mu = np.stack([p[y == c].mean(0) for c in (0, 1)])
    res = p - mu[y]
    cov = res.T @ res / 78
    cov = 0.9 * cov + 0.1 * np.trace(cov) / 4 * np.eye(4)
    assert np.allclose(bank.inverse[29, 0], np.linalg.inv(cov)) and np.allclose(bank.centre[29, :2], mu)
    assert np.allclose(bank.centre[29, 2], p.mean(0))
    plain = C.fit_distances(C.gaussian_sums(df, four, full=False), 2, 4, 10)
    var = (res**2).sum(0) / 78
    assert np.allclose(plain.inverse[29, 0], 1 / (0.9 * var + 0.1 * var.mean()))
    few = C.fit_distances(C.gaussian_sums(df, four, full=False), 2, 4, 1000)
    assert not few.relative(four(x)).any() and few.enough.sum() == 0
    with pytest.raises(Exception, match="known classes"):
        C.gaussian_sums(df.withColumn("label", F.lit(-1)), four).collect()


def test_first_rejection_and_missing_thresholds(spark):
    df = spark.createDataFrame([([0.0, 9.0, 9.0, 9.0] + [0.0] * 26, 4)], "u array<double>, n int")
    got = df.select(C.first_rejection(F.col("u"), [5.0] * 30, F.col("n")).alias("a"), C.first_rejection(F.col("u"), [None] * 30, F.col("n")).alias("b")).first()
    assert (got["a"], got["b"]) == (3, 0)


def test_weeks_may_be_strings(spark):
    d = spark.createDataFrame([(0, "w2"), (0, "w1"), (0, "w1"), (1, "w3"), (1, "w2")], "window_id bigint, period string")
    assert [r["period"] for r in D.dominant_period(d).orderBy("window_id").collect()] == ["w1", "w2"]
    decay = spark.createDataFrame([("a", "w1", 0.9), ("a", "w2", 0.9), ("b", "w3", 0.9), ("b", "w4", 0.8)], "split string, period string, policy_macro_f1 double")
    windows = spark.createDataFrame([(0, "w2"), (1, "w3"), (2, "w4")], "window_id bigint, period string")
    levels = spark.createDataFrame([(0, "none"), (1, "warning"), (2, "alarm")], "window_id bigint, level string")
    r = D.lead_weeks(decay, windows, levels, "a", "b").first()
    assert (r["first_below"], r["warning_week"], r["lead_warning"], r["lead_alarm"]) == ("w4", "w3", 1, 0)


def test_replay_decides_all_windows_in_one_pass_and_blocks_hand_on_their_states(scores, monkeypatch):
    stream = U.stream_order([("a", scores)])
    bank = V.quantile_bank(scores.where("label >= 0"))
    dial = U.Dial(0.7, 0.5, 0.999, 0.5, 0.05)
    loops = {
        "x": U.Loop(6.0, dial, least_flows=10, reject_limit=0.1, targets={3: 4.0}),
        "y": U.Loop(6.0, dial, least_flows=10, follow="p95_k"),
    }
    calls, summarize = [], H.summarize
    monkeypatch.setattr(H, "summarize", lambda *a: calls.append(1) or summarize(*a))
    whole = U.replay(stream, loops, bank=bank, window=20)
    assert len(calls) == 1
    blocks = U.replay(stream, loops, bank=bank, window=20, block=2)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(whole) == rows(blocks) and whole.count() > 8
    assert {r["target"] for r in whole.where("name = 'x' and window_id >= 3").collect()} == {4.0}


def test_a_grid_of_limits_that_all_alarm_gives_null(spark):
    df = spark.createDataFrame([("s", i, 1.5) for i in range(12)], "signal string, window_id bigint, z double")
    assert [r["h"] for r in D.quiet_h(df, [1.0, 2.0]).collect()] == [None]
    assert [r["h"] for r in D.quiet_h(df, D.h_grid()).collect()] == [7.0]


def test_a_score_pass_holds_few_rows_at_a_time(spark):
    class Narrow:
        """A scorer that refuses more rows at a time than a task may hold copies of."""

        version, n_classes, most = "narrow", 2, 512

        def logits(self, x):
            assert len(x) <= self.most
            return np.zeros((len(x), 30, 2))

    n = 3 * Narrow.most + 1
    rows = spark.range(0, n, numPartitions=1).selectExpr("id AS flow_id", "3 AS ppi_len", "array_repeat(0.5D, 60) AS x")
    assert C.score_flows(rows, C.ScoreModel(Narrow())).where("size(pred) = 30").count() == n
    assert C.score_logits(rows, Narrow()).where("size(z) = 60").count() == n
