"""Budget and drift loops on a stream of decided flows, as ``foreachBatch`` sinks.

A count window spans micro-batches. Every batch is numbered with a distributed running count and
summed per window; only those sums (a row per window) reach the loop, which keeps the open window's
sum and a few numbers of state, stored after each batch so that a restarted stream goes on from them.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide import schema as S
from flowtide.operators.budget import Loop
from flowtide.operators.drift import monitor
from flowtide.operators.ordered import global_row_number

MODES = ("auto", "manual", "quality_first")
#: added to every class share before two histograms are compared
KL_FLOOR = 1e-3


def window_sums(decisions: DataFrame, order: list[str], offset: int, window: int, n_classes: int) -> DataFrame:
    """Additive sums per count window of one batch, numbered on from ``offset``."""
    rows = global_row_number(decisions, order, "_rn").withColumn(
        "window_id", F.floor((F.col("_rn") - 1 + offset) / window).cast("bigint")
    )
    d = F.col("decision")
    committed = d.isin("commit", "forced_commit")
    return rows.groupBy("window_id").agg(
        F.count("*").alias("n"), F.sum("k").alias("k"),
        *[F.count(F.when(F.col("k") == k, 1)).alias(f"k{k}") for k in range(S.K_MAX + 1)],
        F.count(F.when(d == "commit", 1)).alias("commits"),
        F.count(F.when(d.isin("reject", "forced_reject"), 1)).alias("rejects"),
        F.sum(F.when(committed, F.col("p_safe"))).alias("p"), F.count(F.when(committed, F.col("p_safe"))).alias("n_p"),
        F.sum("surprise").alias("nll"), F.count("surprise").alias("n_nll"),
        *[F.count(F.when(F.col("prediction") == c, 1)).alias(f"c{c}") for c in range(n_classes)],
    )


def _percentile(sums: dict, q: float) -> float:
    """Linear percentile of K from its 31 counts."""
    n = sums["n"]
    at = q * (n - 1)
    lo, frac = math.floor(at), at - math.floor(at)

    def kth(i: int) -> int:
        seen = 0
        for k in range(S.K_MAX + 1):
            seen += sums[f"k{k}"]
            if seen > i:
                return k
        return S.K_MAX

    return kth(lo) + (kth(min(lo + 1, n - 1)) - kth(lo)) * frac


@dataclass
class WindowLoop:
    """Counts decided flows into windows and judges each full one.

    ``closed`` windows are done, ``open`` holds the sums of the one being filled, ``state`` what the judge
    carries from window to window. With ``folder`` these, the length of a window and the judge's settings are stored
    after every batch beside the rows of its windows, and at once when a setting changes.
    ``resume`` goes on from what was stored last: a restarted stream neither forgets the open window or a setting nor
    judges a batch twice. The rows of windows are then read from the folder; without one they are kept in ``rows``.
    """

    window: int
    n_classes: int
    order: list[str]
    folder: str | None = None
    closed: int = 0
    open: dict = field(default_factory=dict)
    state: dict = field(default_factory=dict)
    rows: list[dict] = field(default_factory=list)
    last_batch: int = -1
    changes: int = 0

    ROW = ""
    STORED = "memory string, rows array<string>, change int, batch bigint"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.last_batch:
            return
        decided = batch.where("decision <> 'undecidable'")
        held = self.open.get("n", 0)
        new: list[dict] = []
        for r in sorted(window_sums(decided, self.order, held, self.window, self.n_classes).collect(), key=lambda r: r["window_id"]):
            part = {k: (v or 0) for k, v in r.asDict().items() if k != "window_id"}
            self.open = {k: self.open.get(k, 0) + v for k, v in part.items()}
            if self.open["n"] >= self.window:
                new += self.judge(self.closed, self.open)
                self.closed, self.open = self.closed + 1, {}
        self.last_batch, self.changes = batch_id, 0
        if self.folder is None:
            self.rows += new
        else:
            self._store(batch.sparkSession, new)

    def judge(self, window_id: int, sums: dict) -> list[dict]:
        """Rows for a full window."""
        raise NotImplementedError

    def _memory(self) -> dict:
        return {"closed": self.closed, "open": self.open, "state": self.state, "window": self.window}

    def _recall(self, memory: dict) -> None:
        for name, value in memory.items():
            setattr(self, name, value)

    def _store(self, spark: SparkSession, rows: list[dict]) -> None:
        kept = [(json.dumps(self._memory()), [json.dumps(r) for r in rows], self.changes)]
        table = spark.createDataFrame(kept, "memory string, rows array<string>, change int").coalesce(1)
        # a batch that was stored in part is written anew, a change is one more file beside its batch
        table.write.mode("append" if self.changes else "overwrite").parquet(f"{self.folder}/batch={self.last_batch}")

    def _changed(self) -> None:
        """Store a setting that was changed between two batches."""
        if self.folder is not None:
            self.changes += 1
            self._store(SparkSession.active(), [])

    def _stored(self, spark: SparkSession) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            return spark.read.schema(self.STORED).parquet(self.folder)
        except AnalysisException:
            return None

    def resume(self, spark: SparkSession) -> WindowLoop:
        """Take up what was stored last; a folder without batches changes nothing."""
        stored = self._stored(spark)
        if stored is not None:
            last = stored.orderBy(F.desc("batch"), F.desc_nulls_last("change")).select("memory", "batch", "change").first()
            if last is not None:
                self._recall(json.loads(last["memory"]))
                self.last_batch, self.changes = last["batch"], last["change"] or 0
        return self

    def table(self, spark: SparkSession) -> DataFrame:
        """The rows of all windows judged."""
        if self.folder is not None:
            stored = self._stored(spark)
            if stored is not None:
                judged = stored.select(F.explode("rows").alias("r"))
                return judged.select(F.from_json("r", self.ROW, {"allowNonNumericNumbers": "true"}).alias("r")).select("r.*")
        names = [c.split()[0] for c in self.ROW.split(", ")]
        return spark.createDataFrame([tuple(r[c] for c in names) for r in self.rows], self.ROW)


@dataclass
class BudgetLoop(WindowLoop):
    """A feedback loop over the windows of a stream.

    Modes: ``auto`` follows the loop; ``manual`` keeps a threshold that was set, ``quality_first`` the
    highest one, and both only record. A change of mode starts a new window.
    """

    loop: Loop = field(default_factory=lambda: Loop(6.0))

    ROW = (
        "window_id bigint, n bigint, metric string, target double, observed double, error double, integral double, theta_commit double,"
        " f double, k_cap int, mode string, reason string"
    )

    def __post_init__(self) -> None:
        if self.window < 10:
            raise ValueError("a window has at least 10 decisions")
        self.state = self.state or {**self.loop.begin(), "mode": MODES[0], "set": None}

    def _memory(self) -> dict:
        return {**super()._memory(), "loop": {"target": self.loop.target, "follow": self.loop.follow}}

    def _recall(self, memory: dict) -> None:
        settings = memory.pop("loop", {})
        super()._recall(memory)
        self.loop = replace(self.loop, **settings)

    @property
    def theta(self) -> float:
        mode = self.state["mode"]
        return self.state["set"] if mode == "manual" else self.loop.commit.high if mode == "quality_first" else self.state["theta"]

    def set_mode(self, mode: str, theta: float | None = None) -> None:
        if mode not in MODES or theta is not None and not 0 < theta < 1:
            raise ValueError(f"a mode is one of {', '.join(MODES)}, a threshold lies between 0 and 1")
        in_force = self.theta
        if mode == "manual":
            self.state["set"] = in_force if theta is None else theta
        elif mode == "auto":
            # go on from the threshold in force
            self.state["theta"] = min(max(in_force, self.loop.commit.low), self.loop.commit.high)
        self.state["mode"], self.open = mode, {}
        self._changed()

    def set_budget(self, target: float | None = None, follow: str | None = None, window: int | None = None) -> None:
        """Change target, what is followed, or the window; the open window starts anew."""
        if window is not None and window < 10:
            raise ValueError("a window has at least 10 decisions")
        self.loop = replace(self.loop, target=self.loop.target if target is None else target, follow=follow or self.loop.follow)
        self.state = self.loop.aimed(self.state, self.loop.target)
        self.window, self.open = window or self.window, {}
        self._changed()

    def judge(self, window_id: int, sums: dict) -> list[dict]:
        seen = {"n": sums["n"], "mean_k": sums["k"] / sums["n"], "p95_k": float(_percentile(sums, 0.95)), "reject_rate": sums["rejects"] / sums["n"]}
        mode, target = self.state["mode"], self.state["target"]
        observed = seen[self.loop.follow]
        reason, error = mode, (observed - target) / target
        if mode == "auto":
            moved, reason, error = self.loop.step(self.state, seen)
            self.state = {**self.state, **moved}
        x = self.state
        return [
            {"window_id": window_id, "n": seen["n"], "metric": self.loop.follow, "target": target, "observed": float(observed), "error": float(error),
             "integral": x["theta_sum"], "theta_commit": self.theta, "f": x["f"], "k_cap": x["k_cap"], "mode": mode, "reason": reason}
        ]


@dataclass
class DriftLoop(WindowLoop):
    """The signals of every window. ``monitored`` standardises them and adds sums, alarms and levels; the rows
    are few, so this is the batch operator over all windows so far."""

    histogram: list[float] = field(default_factory=list)

    ROW = "window_id bigint, n bigint, mean_k double, commit_rate double, reject_rate double, mean_safe_at_commit double, mean_pkt_nll double, prior_kl double"

    def judge(self, window_id: int, sums: dict) -> list[dict]:
        share = lambda part, of: sums[part] / sums[of] if sums[of] else None
        return [
            {"window_id": window_id, "n": sums["n"], "mean_k": share("k", "n"), "commit_rate": share("commits", "n"), "reject_rate": share("rejects", "n"),
             "mean_safe_at_commit": share("p", "n_p"), "mean_pkt_nll": share("nll", "n_nll"), "prior_kl": self._shift(sums)}
        ]

    def _shift(self, sums: dict) -> float | None:
        """How far the window's classes are from the reference histogram, both smoothed."""
        seen, usual = (np.asarray(c, float) for c in ([sums[f"c{c}"] for c in range(self.n_classes)], self.histogram))
        if not seen.sum() or not usual.sum():
            return None
        p, q = ((c / c.sum() + KL_FLOOR) / (1 + KL_FLOOR * len(c)) for c in (seen, usual))
        return float((p * np.log(p / q)).sum())

    def monitored(self, spark: SparkSession, reference: dict[str, tuple[float, float]], h: float = 5.0, warmup: int = 5) -> DataFrame:
        """(window_id, signal, value, z, pos, neg, alarm, level) against each signal's mean and deviation."""
        usual = spark.createDataFrame([(s, float(m), float(d)) for s, (m, d) in reference.items()], "signal string, mean double, std double")
        rows, levels = monitor(self.table(spark), usual, list(reference), h, warmup=warmup)
        return rows.join(levels.select("window_id", "level"), "window_id").select("window_id", "signal", "value", "z", "pos", "neg", "alarm", "level")
