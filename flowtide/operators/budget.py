"""Keeping the mean number of packets on a target while decisions stream by.

A window of decided flows closes, its mean K is compared with the target, and the commit
threshold of the next window follows. Windows are followed in blocks, one job each, that leave the states of
their loops to the next; the flows are decided in one pass once the settings of every window are known. Only the
states after a block reach the driver.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowtide import schema as S
from flowtide.functions.draws import uniform
from flowtide.operators import policies as H
from flowtide.operators import scores as C
from flowtide.operators.ordered import global_row_number, running_totals
from flowtide.session import scratch_path

# --- the stream and its windows -------------------------------------------------------------------


def stream_order(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Parts in the order given, inside a part by (period, flow_id); adds ``part`` and 0-based ``pos``."""
    tagged = [df.withColumns({"part": F.lit(name), "_part_no": F.lit(i)}) for i, (name, df) in enumerate(parts)]
    rows = global_row_number(C.concat(tagged), ["_part_no", "period", "flow_id"], "_rn")
    return rows.withColumn("pos", F.col("_rn") - 1).drop("_rn", "_rn_total", "_part_no")


def spans(stream: DataFrame) -> DataFrame:
    return stream.groupBy("part").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop"))


def count_windows(stream: DataFrame, window: int, drop_ragged: bool = False) -> DataFrame:
    """``window_id`` of fixed flow counts; a last window under half size can be dropped."""
    rows = stream.withColumn("window_id", F.floor(F.col("pos") / window).cast("bigint"))
    if not drop_ragged:
        return rows
    total = stream.agg((F.max("pos") + 1).alias("_total"))
    left = F.col("_total") - F.col("window_id") * window
    return rows.crossJoin(F.broadcast(total)).where(left >= window // 2).drop("_total")


def hard_classes(val: DataFrame, k: int = 5, quantile: float = 0.25, min_flows: int = 20) -> DataFrame:
    """Known classes in the bottom quarter by accuracy at K (classes with few flows are ignored)."""
    rows = C.known_only(val).where(F.col("ppi_len") >= k).select(
        "label", (F.element_at("pred", k) == F.col("label")).cast("double").alias("hit")
    )
    per = rows.groupBy("label").agg(F.avg("hit").alias("accuracy"), F.count("*").alias("n")).where(F.col("n") >= min_flows)
    cut = per.agg(F.percentile("accuracy", F.lit(quantile)).alias("cut"))
    return per.crossJoin(F.broadcast(cut)).where(F.col("accuracy") <= F.col("cut")).drop("cut")


def weighted_draw(rows: DataFrame, weight: Column, n_draws: DataFrame, seed: int, purpose: str) -> DataFrame:
    """Draw with replacement: ``n_draws`` (column ``draw``) x the rows' cumulative weights.

    Both sides are laid on the same line [0, total weight) and merged by one ordered pass: a draw
    takes the first row whose cumulative weight passes it.
    """
    cum = running_totals(rows.withColumn("_w", weight), [], ["pos"], {"_cum": "_w"})
    total = cum.agg(F.max("_cum_total").alias("_t"))
    marks = n_draws.crossJoin(F.broadcast(total)).select(
        (uniform(seed, purpose, F.col("draw")) * F.col("_t")).alias("_x"), "draw"
    )
    line = cum.select(
        F.col("_cum").alias("_x"), F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("draw"), F.col("pos").alias("_tie")
    ).unionByName(marks.select("_x", F.lit(0).alias("_kind"), "draw", F.col("draw").alias("_tie")))
    # number of rows whose cumulative weight is at or below the draw = index of the row taken
    placed = running_totals(line, [], ["_x", "_kind", "_tie"], {"_seen": F.col("_kind").cast("bigint")})
    taken = placed.where("_kind = 0").select("draw", (F.col("_seen") + 1).alias("_i"))
    indexed = global_row_number(rows, ["pos"], "_i").drop("_i_total")
    return taken.join(indexed, "_i").drop("_i")


def double_hard(stream: DataFrame, hard: DataFrame, lo: int, hi: int, seed: int) -> DataFrame:
    """Resample positions [lo, hi) with weight 2 on flows of hard classes."""
    inside = (F.col("pos") >= lo) & (F.col("pos") < hi)
    marked = stream.where(inside).join(
        F.broadcast(hard.select("label").withColumn("_hard", F.lit(1))), "label", "left"
    )
    n = stream.sparkSession.range(lo, hi).withColumnRenamed("id", "draw")
    drawn = weighted_draw(
        marked, F.when(F.col("_hard") == 1, F.lit(2.0)).otherwise(F.lit(1.0)), n, seed, "hard-classes"
    )
    drawn = drawn.withColumn("pos", F.col("draw")).select(*stream.columns)
    return stream.where(~inside).unionByName(drawn)


def unknown_burst(stream: DataFrame, share: float, lo: int, hi: int, seed: int) -> DataFrame:
    """Raise the unknown share of positions [lo, hi) by swapping known flows for unknown ones."""
    inside = (F.col("pos") >= lo) & (F.col("pos") < hi)
    seg = stream.where(inside)
    s = seg.agg(F.avg((F.col("label") < 0).cast("double")).alias("s"), F.sum((F.col("label") < 0).cast("bigint")).alias("n")).first()
    if s["s"] is None or s["s"] >= share or not s["n"]:
        return stream
    q = (share - s["s"]) / (1.0 - s["s"])
    swap = inside & (F.col("label") >= 0) & (uniform(seed, "burst", F.col("pos")) < q)
    pool = global_row_number(seg.where(F.col("label") < 0), ["pos"], "_i").drop("_i_total").drop("pos")
    at = stream.where(swap).select(
        "pos", (F.floor(uniform(seed, "burst-pool", F.col("pos")) * s["n"]) + 1).alias("_i")
    )
    return stream.where(~swap).unionByName(at.join(pool, "_i").select(*stream.columns))


# --- feedback ---------------------------------------------------------------------------------------

FOLLOWED = ("mean_k", "p95_k")
#: errors looked at for swinging, and how large each of them has to be
SWING_LENGTH, SWING_SIZE = 6, 0.05


class Dial(NamedTuple):
    """A threshold that errors turn: where it starts, its rails, the weights of the last error and of the
    carried sum of errors, and the bound of that sum."""

    start: float
    low: float
    high: float
    gain: float
    memory: float
    bound: float = 1.0

    def turned(self, value: float, carried: float, error: float, scale: float = 1.0) -> tuple[float, float, bool]:
        """(value, carried sum, whether the error pushes beyond a rail) after one error, in log odds."""
        carried = float(np.clip(carried + error, -self.bound, self.bound))
        free = H.sigmoid(H.logit(value) - scale * (self.gain * error + self.memory * carried))
        stuck = free <= self.low if error > 0 else free >= self.high and error < 0
        return float(np.clip(free, self.low, self.high)), carried, bool(stuck)


COMMIT_DIAL = Dial(0.9, 0.5, 0.999, 1.0, 0.02)
REJECT_DIAL = Dial(0.02, 0.001, 0.2, 0.2, 0.02)


@dataclass(frozen=True)
class Loop:
    """Settings of a feedback loop. What changes from window to window is its state, a plain dict that can be
    stored as JSON: ``begin`` makes it, ``step`` gives the next one.

    The mean mode turns the commit threshold. The p95 mode moves the last K allowed by one. A limit
    on the rejection rate turns the false-rejection share beside either. A loop that is ``held``
    only records. ``targets`` sets new targets from the windows named.
    """

    target: float
    commit: Dial = COMMIT_DIAL
    reject: Dial = REJECT_DIAL
    follow: str = "mean_k"
    least_flows: int = 200
    caps: tuple[int, int] = (3, S.K_MAX)
    reject_limit: float | None = None
    held: bool = False
    targets: Mapping[int, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        wrong = [d for d in (self.commit, self.reject) if not 0 < d.low <= d.start <= d.high < 1]
        if wrong:
            raise ValueError(f"a dial has to start between its rails, inside (0, 1): {wrong[0]}")
        if self.follow not in FOLLOWED:
            raise ValueError(f"a loop follows one of {', '.join(FOLLOWED)}")
        self.aimed({}, self.target)

    def begin(self) -> dict:
        fresh = {"theta": self.commit.start, "theta_sum": 0.0, "f": self.reject.start, "f_sum": 0.0, "k_cap": self.caps[1], "scale": 1.0}
        return self.aimed(fresh, self.target)

    def aimed(self, state: Mapping, target: float) -> dict:
        """The state with a new target; what was remembered about the old one is forgotten."""
        if not target > 0:
            raise ValueError("a target is a positive number of packets")
        return {**state, "target": float(target), "errors": [], "stuck": False}

    def step(self, state: Mapping, window: Mapping) -> tuple[dict, str, float]:
        """(next state, what happened, relative error) for a window with n, mean_k, p95_k, reject_rate."""
        error = (window[self.follow] - state["target"]) / state["target"]
        if self.held:
            return dict(state), "static", error
        if window["n"] < self.least_flows:
            return dict(state), "frozen", 0.0
        new = dict(state)
        if self.follow == "mean_k":
            new["theta"], new["theta_sum"], stuck = self.commit.turned(state["theta"], state["theta_sum"], error, state["scale"])
        else:
            new["k_cap"] = int(np.clip(state["k_cap"] + (-1 if error > 0 else 1), *self.caps))
            stuck = error > 0 and new["k_cap"] == self.caps[0]
        if self.reject_limit is not None:
            excess = (window["reject_rate"] - self.reject_limit) / max(self.reject_limit, 1e-9)
            new["f"], new["f_sum"], _ = self.reject.turned(state["f"], state["f_sum"], excess)
        what = ["infeasible" if stuck and not state["stuck"] else "update"]
        new["stuck"] = stuck
        new["errors"] = [*state["errors"], error][-SWING_LENGTH:]
        if _swings(new["errors"]):
            new["scale"], new["errors"] = state["scale"] / 2, []
            what.append("oscillation")
        return new, "+".join(what), error


def _swings(errors: Sequence[float]) -> bool:
    """Whether a full run of errors is large throughout and changes its sign at every step."""
    e = np.asarray(errors)
    return len(e) == SWING_LENGTH and bool((np.abs(e) > SWING_SIZE).all() and (e[1:] * e[:-1] < 0).all())


def lay_out(stream: DataFrame, window: int, block: int = 64) -> tuple[DataFrame, int, int]:
    """Write the stream by blocks of windows; (table, windows, flows). A window then reads its own
    block's files only."""
    rows = count_windows(stream, window).withColumn("block", F.floor(F.col("window_id") / block).cast("bigint"))
    path = scratch_path(stream.sparkSession, "windows")
    rows.repartitionByRange("block", "window_id", "pos").sortWithinPartitions("window_id").write.partitionBy("block").parquet(path)
    table = stream.sparkSession.read.parquet(path)
    top = table.agg(F.max("window_id").alias("w"), F.count("*").alias("n")).first()
    return table, int(top["w"]) + 1, int(top["n"])


#: flows of a block of windows; a task reads a block, and the next one goes on with the states it leaves
FOLD_FLOWS = 250_000

#: what a loop said in a window, and its state after the last window of a block
_FOLDED = (
    "name string, window_id bigint, target double, theta double, k_cap int, f double, reason string, error double,"
    " integral double, th array<double>, state string"
)
_FOLDED_ARROW = pa.schema(
    [("name", pa.string()), ("window_id", pa.int64()), ("target", pa.float64()), ("theta", pa.float64()), ("k_cap", pa.int32()),
     ("f", pa.float64()), ("reason", pa.string()), ("error", pa.float64()), ("integral", pa.float64()), ("th", pa.list_(pa.float64())),
     ("state", pa.string())]
)

WINDOW_ROW = (
    "name string, window_id bigint, start bigint, n bigint, target double, theta double, k_cap int, f double,"
    " mean_k double, p95_k double, forced_rate double, known_accuracy double, known_reject_rate double,"
    " unknown_reject_rate double, reject_rate double, reason string, error double, integral double"
)


class Answers:
    """What the flows of one window answer to any setting: the rule of ``policies.safe_stop`` on matrices [n, 30]."""

    def __init__(self, p: np.ndarray, u: np.ndarray, ppi_len: np.ndarray, order: str, k_min: int = 2, k_ood: int = 3) -> None:
        k = np.arange(1, S.K_MAX + 1)
        self.p = np.where(np.isnan(p), 0.0, p)
        self.u = np.where(np.isnan(u), np.inf, u)
        self.len, self.order = ppi_len, order
        self.may_commit, self.may_reject, self.k = k >= k_min, k >= k_ood, k

    def window(self, theta: float, th: Sequence[float | None], cap: int) -> dict[str, float]:
        """n, mean_k, p95_k and reject_rate, as ``policies.summarize`` gives them."""
        n = len(self.len)
        last = np.minimum(self.len, cap)
        within = self.k[None] <= last[:, None]
        # a threshold that is missing rejects nothing
        over = self.u >= np.array([np.nan if t is None else t for t in th])[None]

        def first(mask: np.ndarray) -> np.ndarray:
            return np.where(mask.any(axis=1), mask.argmax(axis=1) + 1, S.K_MAX + 1)

        kr = first(over & self.may_reject[None] & within)
        kc = first((self.p >= theta) & self.may_commit[None] & within)
        early = np.minimum(kr, kc)
        stopped = early <= S.K_MAX
        at = np.where(stopped, early, last)
        wins = kr <= kc if self.order == "reject_first" else kr < kc
        rejected = np.where(stopped, wins, over[np.arange(n), np.maximum(last, 1) - 1])
        line = np.sort(at)
        place = (n - 1) * 0.95
        lo, hi = math.floor(place), math.ceil(place)
        p95 = float(line[lo]) if line[lo] == line[hi] else (hi - place) * float(line[lo]) + (place - lo) * float(line[hi])
        return {"n": n, "mean_k": float(at.sum()) / n, "p95_k": p95, "reject_rate": float(rejected.sum()) / n}


def _fold(
    flows: DataFrame, loops: Mapping[str, Loop], states: Mapping[str, dict], reject_at: Callable[[float], Sequence], order: str, done: int
) -> DataFrame:
    """Loops over the windows of one block, from the states given: a row (``_FOLDED``) per window and loop. ``done`` is
    the last window before. The task holds one window at a time."""
    has_u = "u" in flows.columns
    rows = flows.select("window_id", "ppi_len", "p_safe", *(["u"] if has_u else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = {name: dict(x) for name, x in states.items()}, done
        here: int | None = None
        parts: list[tuple] = []

        def close() -> list[dict]:
            nonlocal before, parts
            p, u, length = (np.concatenate(c) for c in zip(*parts, strict=True))
            answers, out, parts = Answers(p, u, length, order), [], []
            for name, loop in loops.items():
                for w in sorted(w for w in loop.targets if before < w <= here):
                    held[name] = loop.aimed(held[name], loop.targets[w])
                was, th = held[name], reject_at(held[name]["f"])
                held[name], reason, error = loop.step(was, answers.window(was["theta"], th, was["k_cap"]))
                out.append(
                    {"name": name, "window_id": here, **{c: was[c] for c in ("target", "theta", "k_cap", "f")}, "reason": reason,
                     "error": float(error), "integral": held[name]["theta_sum"], "th": list(th)}
                )
            before = here
            return out

        for b in batches:
            if not b.num_rows:
                continue
            ids, length = b.column("window_id").to_numpy(), b.column("ppi_len").to_numpy()
            p = C._matrix(b.column("p_safe"))
            u = C._matrix(b.column("u")) if has_u else np.zeros(p.shape)
            edges = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            made: list[dict] = []
            for lo, hi in zip(edges, edges[1:]):
                if here is not None and ids[lo] != here:
                    made += close()
                here = int(ids[lo])
                parts.append((p[lo:hi], u[lo:hi], length[lo:hi]))
            if made:
                yield pa.RecordBatch.from_pylist(made, _FOLDED_ARROW)
        if parts:
            made = close()
            yield pa.RecordBatch.from_pylist([{**r, "state": json.dumps(held[r["name"]])} for r in made], _FOLDED_ARROW)

    return rows.repartition(1).sortWithinPartitions("window_id").mapInArrow(run, _FOLDED)


def replay(
    stream: DataFrame,
    loops: Mapping[str, Loop],
    *,
    bank=None,
    window: int = 2000,
    order: str = "reject_first",
    block: int | None = None,
) -> DataFrame:
    """Run feedback loops over an ordered stream; one row per window and loop.

    Every flow of a window uses what its loop's state says when the window opens. The loops are followed block by block
    (``block`` windows, by default about ``FOLD_FLOWS`` flows), one job a block that leaves its states to the next. With
    the settings of every window known, all flows are decided and summed up in one distributed pass. ``bank`` is the
    quantile bank the per-K reject thresholds of an ``f`` come from; without it nothing is rejected.
    """
    from flowtide.operators.evaluate import theta_at

    spark = stream.sparkSession
    H._check_order(order)
    block = block or max(1, FOLD_FLOWS // window)
    keep = ["flow_id", "label", "ppi_len", "pos", "p_safe", "pred"] + (["u"] if bank is not None else [])
    states = {name: loop.begin() for name, loop in loops.items()}
    rejects: dict[float, Sequence] = {}

    def reject_at(f: float) -> Sequence:
        f = round(f, 6)
        if bank is None:
            return H.NEVER
        if f not in rejects:
            if len(rejects) > 1000:
                rejects.clear()
            rejects[f] = theta_at(bank, f)
        return rejects[f]

    table, n_windows, _ = lay_out(stream.select(*keep), window, block)
    path, done, blocks = scratch_path(spark, "replay"), -1, []
    for b in range(-(-n_windows // block)):
        blocks.append(f"{path}/{b}")
        _fold(table.where(F.col("block") == b), loops, states, reject_at, order, done).write.parquet(blocks[-1])
        for r in spark.read.schema(_FOLDED).parquet(blocks[-1]).where("state is not null").collect():
            states[r["name"]], done = json.loads(r["state"]), r["window_id"]
    folded = spark.read.schema(_FOLDED).parquet(*blocks).drop("state")

    # when only commit thresholds move, a flow's answer to every threshold is worked out once
    firsts = {round(loop.reject.start, 6) for loop in loops.values()}
    fixed = len(firsts) == 1 and all(x.follow == "mean_k" and x.reject_limit is None and x.caps[1] == S.K_MAX for x in loops.values())
    rejected = F.col("decision").isin(S.REJECT, S.FORCED_REJECT).cast("double")
    more = [F.avg(rejected).alias("reject_rate"), F.min("pos").alias("start")]
    covers = (F.col("above").isNull() | (F.col("above") < F.col("theta"))) & (
        F.col("upto").isNull() | (F.col("theta") <= F.col("upto"))
    )
    forces = folded.select("window_id", "name", "theta", F.col("k_cap").alias("cap"), *([] if fixed else ["th"]))
    if fixed:
        segments = H.record_segments(
            table, "p_safe", k_min=2, theta_reject=reject_at(min(firsts)), order=order, keep=("flow_id", "label", "pos", "window_id")
        )
        decided = segments.join(forces, "window_id").where(covers)
    else:
        decided = H.safe_stop(
            table.join(forces, "window_id"), F.col("theta"), F.col("th"), order=order, k_cap=F.col("cap"),
            keep=["flow_id", "label", "name", "pos", "window_id"],
        )
    sums = H.summarize(decided, ["name", "window_id"], more)
    said = folded.select("name", "window_id", "target", "theta", "k_cap", "f", "reason", "error", "integral")
    return said.join(sums, ["name", "window_id"]).select(*[c.split()[0] for c in WINDOW_ROW.split(", ")])


def tracking_summary(
    windows: DataFrame, *, warmup: int = 5, tol: float = 0.05, run: int = 3, by: Sequence[str] = ("name",)
) -> DataFrame:
    """Error after the warm-up, share within tolerance, accuracy, settling after target steps, events.

    ``windows`` has one row per window; windows under half the largest are left out of the errors.
    """
    by = list(by)
    w = W.partitionBy(*by).orderBy("window_id")
    ahead = w.rowsBetween(0, run - 1)
    signed = (F.col("mean_k") - F.col("target")) / F.col("target")
    rows = (
        windows.withColumn("_signed", signed)
        .withColumn("_err", F.abs("_signed"))
        .withColumn("_full", F.col("n") >= 0.5 * F.max("n").over(W.partitionBy(*by)))
        .withColumn("_i", F.row_number().over(w) - 1)
        .withColumn("_step", F.coalesce((F.col("target") != F.lag("target").over(w)).cast("int"), F.lit(0)))
        .withColumn("_count", F.count("*").over(ahead))
        .withColumn("_strict", (F.col("_count") == run) & (F.max("_err").over(ahead) <= tol))
        .withColumn("_smooth", (F.col("_count") == run) & (F.abs(F.avg("_signed").over(ahead)) <= tol))
    )
    use = F.col("_full") & (F.col("_i") >= warmup)
    weight = F.when(use & F.col("known_accuracy").isNotNull(), F.col("n"))
    main = rows.groupBy(*by).agg(
        F.count("*").alias("windows"),
        F.avg(F.when(use, F.col("_err"))).alias("mean_abs_error"),
        F.max(F.when(use, F.col("_err"))).alias("max_abs_error"),
        F.avg(F.when(use, (F.col("_err") <= tol).cast("double"))).alias("within_tol"),
        (F.sum(weight * F.col("known_accuracy")) / F.greatest(F.sum(weight), F.lit(1))).alias("accuracy"),
        F.sum(F.col("reason").contains("oscillation").cast("bigint")).alias("oscillation_events"),
        F.sum(F.col("reason").startswith("infeasible").cast("bigint")).alias("infeasible_events"),
    )
    # a step settles at the first later window that starts a good run; -1 when none does
    good = lambda c: F.min(F.when(F.col(c), F.col("_i"))).over(w.rowsBetween(0, W.unboundedFollowing))
    steps = (
        rows.withColumn("_s", good("_strict") - F.col("_i"))
        .withColumn("_m", good("_smooth") - F.col("_i"))
        .where("_step = 1")
        .groupBy(*by)
        .agg(
            F.transform(F.array_sort(F.collect_list(F.struct("_i", F.coalesce("_s", F.lit(-1)).alias("v")))), lambda e: e["v"]).alias("settling"),
            F.transform(F.array_sort(F.collect_list(F.struct("_i", F.coalesce("_m", F.lit(-1)).alias("v")))), lambda e: e["v"]).alias("settling_smoothed"),
        )
    )
    empty = F.array().cast("array<int>")
    return main.join(steps, by, "left").withColumns(
        {"settling": F.coalesce("settling", empty), "settling_smoothed": F.coalesce("settling_smoothed", empty)}
    )


GAIN_GRID = [(kp, ki) for kp in (0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0) for ki in (0.0, 0.02, 0.05)]


def tune_gains(
    val: DataFrame, *, target: float = 6.0, grid: Sequence[tuple[float, float]] = tuple(GAIN_GRID), bank=None,
    f: float = 0.02, window: int = 2000, min_flows: int = 200,
) -> DataFrame:
    """Gains on the validation stream: (kp, ki, qualified, summary…, chosen).

    Step schedule target, 0.6 target, target. Qualified pairs neither oscillate nor take more than
    5 windows to settle; the least error wins among them, or among all when none qualifies. All
    pairs run in one replay.
    """
    from flowtide.operators.evaluate import theta_at

    stream = stream_order([("val", val)])
    kw = {} if bank is None else {"theta_reject": theta_at(bank, f)}
    theta0 = H.calibrate_theta(val, target, **kw)["theta"]
    n_win = -(-val.count() // window)
    steps = {n_win // 3: 0.6 * target, 2 * n_win // 3: target}
    loops = {
        f"{kp}/{ki}": Loop(target, COMMIT_DIAL._replace(start=theta0, gain=kp, memory=ki), least_flows=min_flows, targets=steps)
        for kp, ki in grid
    }
    summary = tracking_summary(replay(stream, loops, bank=bank, window=window))
    parts = F.split("name", "/")
    rows = summary.select(
        parts[0].cast("double").alias("kp"), parts[1].cast("double").alias("ki"),
        (
            (F.col("oscillation_events") == 0) & (F.size("settling") > 0)
            & F.forall("settling", lambda v: (v >= 0) & (v <= 5))
        ).alias("qualified"),
        *[c for c in summary.columns if c != "name"],
    )
    best = W.orderBy(F.col("qualified").desc(), F.col("mean_abs_error"), "kp", "ki")
    return rows.withColumn("chosen", F.row_number().over(best) == 1)


def controller_report(
    parts: Sequence[tuple[str, DataFrame]], *, budgets: Sequence[float] = (4.0, 6.0, 8.0), gains: tuple[float, float],
    bank=None, f: float = 0.02, window: int = 2000, min_flows: int = 200, seed: int = 0,
) -> DataFrame:
    """Controller against static threshold: per budget and span, and under three disturbances."""
    from flowtide.operators.evaluate import theta_at
    from flowtide.session import cut

    kw = {} if bank is None else {"theta_reject": theta_at(bank, f)}
    kp, ki = gains
    val = parts[0][1]
    stream = cut(stream_order(parts))
    bounds = {r["part"]: (r["start"], r["stop"]) for r in spans(stream).collect()}

    def pair(target: float, theta: float, targets: Mapping[int, float] | None = None, tag: str = "") -> dict[str, Loop]:
        moving = Loop(target, COMMIT_DIAL._replace(start=theta, gain=kp, memory=ki), least_flows=min_flows, targets=dict(targets or {}))
        return {f"{tag}controller": moving, f"{tag}static": replace(moving, held=True)}

    start = {b: H.calibrate_theta(val, b, **kw)["theta"] for b in budgets}
    loops = {k: v for b in budgets for k, v in pair(b, start[b], tag=f"{b}|").items()}
    windows = replay(stream, loops, bank=bank, window=window)
    cases = []
    for i, (name, (lo, hi)) in enumerate((n, bounds[n]) for n, _ in parts):
        inside = windows.where((F.col("start") >= lo) & (F.col("start") < hi))
        cases.append(tracking_summary(inside, warmup=5 if i == 0 else 0).withColumn("case", F.lit(f"span:{name}")))
    middle = sorted(budgets)[len(budgets) // 2]
    (t_lo, t_hi), (d_lo, d_hi) = bounds[parts[1][0]], bounds[parts[2][0]]
    third = (d_hi - d_lo) // 3
    hard = hard_classes(val)
    burst_lo = t_lo + (t_hi - t_lo) // 3
    for case, changed in (
        ("hard_classes_doubled", double_hard(stream, hard, d_lo + third, d_lo + 2 * third, seed)),
        ("unknown_burst", unknown_burst(stream, 0.3, burst_lo, min(burst_lo + 20 * window, t_hi), seed)),
    ):
        w = replay(changed, pair(middle, start[middle], tag=f"{middle}|"), bank=bank, window=window)
        cases.append(tracking_summary(w).withColumn("case", F.lit(case)))
    top = max(budgets)
    n_win = -(-(t_hi - t_lo) // window)
    test = stream.where(F.col("part") == parts[1][0]).withColumn("pos", F.col("pos") - t_lo)
    w = replay(
        test, pair(top, start[top], {n_win // 3: min(budgets) + 1.0, 2 * n_win // 3: top}, tag=f"{top}|"), bank=bank, window=window
    )
    cases.append(tracking_summary(w).withColumn("case", F.lit("target_step")))
    out = C.concat(cases)
    parts_of = F.split("name", r"\|")
    return out.withColumns({"budget": parts_of[0].cast("double"), "mode": parts_of[1]}).drop("name")


__all__ = [
    "Dial", "Loop", "controller_report", "count_windows", "double_hard", "hard_classes",
    "lay_out", "replay", "spans", "stream_order", "tracking_summary", "tune_gains", "unknown_burst", "weighted_draw",
]
