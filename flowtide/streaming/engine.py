"""Online decisions: one state per flow, every new prefix scored once, one decision per flow."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowtide import schema as S
from flowtide.operators.scores import ScoreModel
from flowtide.streaming.replay import END

UNDECIDABLE = "undecidable"

OUTPUT = (
    "kind string, flow_id bigint, label int, k int, decision string, prediction int, p_safe double, u double,"
    " theta_commit double, time_units bigint, ignored int, model_version string, decided_at timestamp"
)


@dataclass(frozen=True)
class Version:
    """A model and the event time (ms) from which new flows use it."""

    model: ScoreModel
    since_ms: int = 0
    theta_reject: tuple[float | None, ...] = tuple([None] * S.K_MAX)

    @property
    def name(self) -> str:
        return self.model.scorer.version


@dataclass(frozen=True)
class Rules:
    theta_commit: float = 0.5
    k_min: int = 2
    k_ood: int = 3
    order: str = "reject_first"
    k_cap: int = S.K_MAX
    idle_s: float = 60.0
    done_s: float = 3600.0
    trace: bool = False
    unknown: str = "u"  # score column compared with theta_reject


def rule(
    k: int, p: float, u: float, pred: int, theta_reject: float | None, last: int, r: Rules
) -> tuple[int, int] | None:
    """(decision, class) after ``k`` packets or None: the per-prefix rule of the batch policies."""
    p = 0.0 if math.isnan(p) else p
    u = math.inf if math.isnan(u) else u
    over = theta_reject is not None and u >= theta_reject
    answers = [(S.REJECT, k >= r.k_ood and over), (S.COMMIT, k >= r.k_min and p >= r.theta_commit)]
    if r.order == "commit_first":
        answers.reverse()
    answers += [(S.FORCED_REJECT, k == last and over), (S.FORCED_COMMIT, k == last)]
    for code, holds in answers:
        if holds:
            return code, (S.UNKNOWN if code in (S.REJECT, S.FORCED_REJECT) else pred)
    return None


def features(ipt: Sequence[int], direction: Sequence[int], size: Sequence[int]) -> np.ndarray:
    """[1, 60]: two numbers per packet, zero past the prefix."""
    x = np.zeros((1, 2 * S.K_MAX))
    n = len(ipt)
    x[0, 0 : 2 * n : 2] = np.log1p(np.asarray(size, dtype=np.float64)) * np.asarray(direction)
    x[0, 1 : 2 * n : 2] = np.log1p(np.asarray(ipt, dtype=np.float64))
    return x


def feature_column(ppi: Column) -> Column:
    """The same 60 numbers from a stored sequence."""
    pairs = F.flatten(
        F.transform(ppi, lambda p: F.array(F.log1p(p["size"].cast("double")) * p["dir"], F.log1p(p["ipt"].cast("double"))))
    )
    return F.concat(pairs, F.array_repeat(F.lit(0.0), F.lit(2 * S.K_MAX) - F.size(pairs)))


STATE = "ipt array<int>, dir array<int>, size array<int>, scored int, last_ms bigint, ignored int, done boolean, version string"
_EMPTY = ([], [], [], 0, 0, 0, False, "")


@dataclass
class _Flow:
    ipt: list[int] = field(default_factory=list)
    dir: list[int] = field(default_factory=list)
    size: list[int] = field(default_factory=list)
    scored: int = 0
    last_ms: int = 0
    ignored: int = 0
    done: bool = False
    version: str = ""

    def row(self) -> tuple:
        return (self.ipt, self.dir, self.size, self.scored, self.last_ms, self.ignored, self.done, self.version)


class DecisionProcessor(StatefulProcessor):
    """Prefix state of one flow; emits its decision, and a trace row per prefix when asked.

    A packet counts when it is the next expected one; duplicates, gaps and packets past 30 or after
    the decision are ignored and counted. Silence of ``idle_s`` forces the decision. The model is
    chosen at the first packet and stays with the flow. Once decided only a marker is kept, and
    that for ``done_s``.
    """

    def __init__(self, versions: Sequence[Version], rules: Rules) -> None:
        self.versions = {v.name: v for v in versions}
        self.in_order = sorted(versions, key=lambda v: v.since_ms)
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("flow", STATE)

    def _load(self) -> _Flow:
        if not self.state.exists():
            return _Flow()
        got = self.state.get()
        return _Flow(list(got[0]), list(got[1]), list(got[2]), *got[3:])

    def _score(self, st: _Flow) -> dict[str, np.ndarray]:
        return self.versions[st.version].model.columns(features(st.ipt, st.dir, st.size), np.array([S.K_MAX]))

    def _emit(self, kind: str, key: int, label: int | None, st: _Flow, k: int, cols: dict | None, got: tuple | None, at_ms: int) -> tuple:
        p = float(cols["p_safe"][0, k - 1]) if cols is not None else None
        u = float(cols[self.rules.unknown][0, k - 1]) if cols is not None and self.rules.unknown in cols else None
        name = UNDECIDABLE if got is None else S.DECISIONS[got[0]]
        cls = got[1] if got is not None else None
        if kind == "trace":
            name, cls = None, int(cols["pred"][0, k - 1])
        return (
            kind, key, label, k, name, cls, p, u, self.rules.theta_commit, int(sum(st.ipt[:k])), st.ignored, st.version,
            pd.Timestamp(at_ms, unit="ms"),
        )

    def _advance(self, key: int, label: int | None, st: _Flow, ended: bool, at_ms: int) -> list[tuple]:
        """Score the new prefixes in order; stop at the first that decides."""
        out: list[tuple] = []
        n, r = len(st.ipt), self.rules
        if n == 0:
            if ended:
                out.append(self._emit("decision", key, label, st, 0, None, None, at_ms))
                st.done = True
            return out
        if st.scored == n and not ended:
            return out
        cols = self._score(st)
        theta = self.versions[st.version].theta_reject
        start = st.scored + 1 if st.scored < n else n
        for k in range(start, n + 1):
            if r.trace and k > st.scored:
                out.append(self._emit("trace", key, label, st, k, cols, None, at_ms))
            last = k if (ended and k == n) or k >= r.k_cap else r.k_cap
            u = float(cols[r.unknown][0, k - 1]) if r.unknown in cols else 0.0
            got = rule(k, float(cols["p_safe"][0, k - 1]), u, int(cols["pred"][0, k - 1]), theta[k - 1], last, r)
            st.scored = k
            if got is not None:
                out.append(self._emit("decision", key, label, st, k, cols, got, at_ms))
                st.done = True
                break
        return out

    def _save(self, st: _Flow, label: int | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        wait = self.rules.done_s if st.done else self.rules.idle_s
        self.handle.registerTimer(int(st.last_ms + 1000 * wait))
        if st.done:
            st.ipt, st.dir, st.size = [], [], []
        self.state.update(st.row())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        flow_id = int(key[0])
        st = self._load()
        parts = pd.concat(list(rows))
        # arrival order inside a batch: packets by index, the end marker last
        order = parts["index"].where(parts["index"] >= 0, 2**30)
        parts = parts.assign(_o=order).sort_values("_o", kind="mergesort")
        label = None if parts["label"].isna().all() else int(parts["label"].dropna().iloc[0])
        out: list[tuple] = []
        ended = False
        seen_ms = int(parts["event_time"].max().value // 1_000_000)
        for e in parts.itertuples():
            if st.done:
                st.ignored += 1
                continue
            if not st.version:
                ms = int(e.event_time.value // 1_000_000)
                usable = [v for v in self.in_order if v.since_ms <= ms] or self.in_order[:1]
                st.version = usable[-1].name
            if e.index == END:
                ended = True
            elif e.index != len(st.ipt) or len(st.ipt) >= S.K_MAX:
                st.ignored += 1
            else:
                st.ipt.append(int(e.ipt))
                st.dir.append(int(e.dir))
                st.size.append(int(e.size))
        st.last_ms = max(st.last_ms, seen_ms)
        if not st.done:
            out = self._advance(flow_id, label, st, ended, st.last_ms)
        self._save(st, label)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        st = self._load()
        if st.done or not self.state.exists():
            self.state.clear()
            return
        out = self._advance(int(key[0]), None, st, True, expiredTimerInfo.getExpiryTimeInMs())
        st.last_ms = expiredTimerInfo.getExpiryTimeInMs()
        self._save(st, None)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def decide_stream(
    events: DataFrame, versions: Sequence[Version], rules: Rules = Rules(), watermark: str = "10 minutes"
) -> DataFrame:
    """Decisions (and trace rows) of a stream of packet events."""
    return (
        events.withWatermark("event_time", watermark)
        .groupBy("flow_id")
        .transformWithStateInPandas(
            statefulProcessor=DecisionProcessor(versions, rules),
            outputStructType=OUTPUT,
            outputMode="Append",
            timeMode="EventTime",
        )
    )


# --- incremental features ---------------------------------------------------------------------------

TOKENS = "flow_id bigint, j int, ipt_token int, dir_token int, size_token int, push_token int"


def _token(v: np.ndarray, bins: int, top: int) -> np.ndarray:
    scaled = np.ceil(np.log(np.maximum(v, 1).astype(np.float64)) * (bins / math.log(top)))
    return np.clip(scaled, 1, bins).astype(int)


class FeatureProcessor(StatefulProcessor):
    """Tokens of every new packet; nothing past 30. State is the length only: tokens of earlier
    packets never change."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("length", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        n = self.state.get()[0] if self.state.exists() else 0
        parts = pd.concat(list(rows))
        parts = parts[parts["index"] >= 0].sort_values("index", kind="mergesort")
        take = []
        for i, idx in enumerate(parts["index"]):
            if idx == n and n < S.K_MAX:
                take.append(i)
                n += 1
        self.state.update((n,))
        p = parts.iloc[take]
        if len(p):
            yield pd.DataFrame(
                {
                    "flow_id": int(key[0]), "j": p["index"].astype(int) + 1,
                    "ipt_token": _token(np.clip(p["ipt"].to_numpy(), 0, S.IPT_MAX), S.IPT_TOKENS, S.IPT_MAX),
                    "dir_token": np.where(p["dir"] == -1, 2, p["dir"]).astype(int),
                    "size_token": _token(np.clip(p["size"].to_numpy(), 0, S.SIZE_MAX), S.SIZE_TOKENS, S.SIZE_MAX),
                    "push_token": p["push"].astype(int) + 1,
                }
            )

    def close(self) -> None:
        pass


def feature_stream(events: DataFrame) -> DataFrame:
    return events.groupBy("flow_id").transformWithStateInPandas(
        statefulProcessor=FeatureProcessor(), outputStructType=TOKENS, outputMode="Append", timeMode="None"
    )
