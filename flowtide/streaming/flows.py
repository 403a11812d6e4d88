"""Flow assembly over a packet stream, and time windows over it."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowtide import schema as S
from flowtide.bindings import Timeouts

#: a row of this protocol closes what is open: the capture is over
FLUSH = -1

PACKETS = T.StructType(
    [
        T.StructField("flow_key", T.LongType()), T.StructField("ts_us", T.LongType()), T.StructField("pkt_id", T.LongType()),
        T.StructField("side", T.IntegerType()), T.StructField("proto", T.IntegerType()),
        T.StructField("payload_len", T.LongType()), T.StructField("flags", T.IntegerType()),
        T.StructField("event_time", T.TimestampType()),
    ]
)

FLOWS = (
    "flow_key bigint, flow_id bigint, proto int, start_us bigint, end_us bigint, initiator int, packets bigint,"
    " packets_rev bigint, bytes bigint, bytes_rev bigint, flags_seen int, clock_jumps bigint, end_reason string,"
    " ppi array<struct<ipt:int,dir:int,size:int,push:int>>, ppi_len int"
)
_COLUMNS = [c.split()[0] for c in FLOWS.replace("<ipt:int,dir:int,size:int,push:int>", "").split(", ")]

STATE = (
    "flow_id bigint, proto int, start_us bigint, last_us bigint, initiator int, n array<bigint>, b array<bigint>, flags int,"
    " fin int, close_at bigint, pay_us bigint, jumps bigint, ipt array<int>, dir array<int>, size array<int>, push array<int>"
)


#: rows of one key that a task sorts at a time, and rows of such a sorted run that it reads at a time
HELD_ROWS, PIECE_ROWS = 50_000, 2_000
#: sorted runs that are merged at a time
FAN_IN = 16
#: keys are dealt into so many groups, handed over a group at a time: a call for every key costs more than its packets
GROUPS = 1024


class Packet(NamedTuple):
    flow_key: int
    ts_us: int
    pkt_id: int
    side: int
    proto: int
    payload_len: int
    flags: int


class FlowProcessor(StatefulProcessor):
    """The open flows of a group of keys, one each. A flow closes at the packet that finds it expired, at an RST, at
    the flush row, or, with ``timers``, when the watermark passes its expiry; then a group is one key.

    A group's rows of one batch are put in order of key and time. Up to ``held`` rows that is a sort in memory; more
    rows, as of a hot key, go to the state store as sorted runs, which are merged piece by piece, so a task
    holds about ``held`` rows however many a batch has.
    """

    def __init__(self, timeouts: Timeouts, timers: bool, held: int = HELD_ROWS, piece: int = PIECE_ROWS) -> None:
        self.t, self.timers, self.held, self.piece = timeouts, timers, held, piece

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getMapState("open", "flow_key bigint", STATE)
        self.runs = handle.getMapState("runs", "run int, piece int", "rows binary")

    def _chunks(self, rows: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        """The packets in arrival order, in sorted arrays of at most ``held`` rows."""
        kept: list[np.ndarray] = []
        size = 0
        for frame in rows:
            if frame["flow_key"].isna().any():
                raise TypeError("a packet without a flow key")
            values = np.stack([frame[c].to_numpy(np.int64) for c in Packet._fields], axis=1)
            while size + len(values) > self.held:
                room = self.held - size
                yield _in_time(np.concatenate([*kept, values[:room]]))
                kept, size, values = [], 0, values[room:]
            kept.append(values)
            size += len(values)
        if size:
            yield _in_time(np.concatenate(kept))

    def _store(self, run: int, ordered: Iterator[np.ndarray]) -> int:
        """Write a sorted run; the number of its pieces."""
        pieces = 0
        for part in ordered:
            self.runs.updateValue((run, pieces), (part.tobytes(),))
            pieces += 1
        return pieces

    def _read(self, run: int, pieces: int) -> Iterator[Packet]:
        """A run from the state store; what is read is removed."""
        for piece in range(pieces):
            part = np.frombuffer(bytes(self.runs.getValue((run, piece))[0]), np.int64).reshape(-1, len(Packet._fields))
            self.runs.removeKey((run, piece))
            yield from map(Packet._make, part.tolist())

    def _pieces(self, packets: Iterator[Packet]) -> Iterator[np.ndarray]:
        held: list[Packet] = []
        for p in packets:
            held.append(p)
            if len(held) == self.piece:
                yield np.array(held, np.int64)
                held = []
        if held:
            yield np.array(held, np.int64)

    def _ordered(self, rows: Iterator[pd.DataFrame]) -> Iterator[Packet]:
        """The packets by key, time and number; equal ones stay in arrival order."""
        chunks = self._chunks(rows)
        first = next(chunks, None)
        if first is None:
            return
        second = next(chunks, None)
        if second is None:
            yield from map(Packet._make, first.tolist())
            return
        place = lambda p: p[:3]
        runs: list[tuple[int, int]] = []
        for chunk in (first, second):
            runs.append((len(runs), self._store(len(runs), _cut(chunk, self.piece))))
        del first, second, chunk
        for chunk in chunks:
            runs.append((len(runs), self._store(len(runs), _cut(chunk, self.piece))))
        made = len(runs)
        while len(runs) > FAN_IN:
            merged = []
            for i in range(0, len(runs), FAN_IN):
                one = heapq.merge(*[self._read(*r) for r in runs[i : i + FAN_IN]], key=place)
                merged.append((made, self._store(made, self._pieces(one))))
                made += 1
            runs = merged
        yield from heapq.merge(*[self._read(*r) for r in runs], key=place)

    def _reason(self, s: dict[str, Any], now: int) -> str | None:
        idle = self.t.udp if s["proto"] == S.UDP else self.t.idle_us
        if s["close_at"] >= 0 and now >= s["close_at"]:
            return "fin"
        if now - s["last_us"] >= idle:
            return "idle"
        if self.t.active_us is not None and now - s["start_us"] >= self.t.active_us:
            return "active"
        return None

    def _expiry(self, s: dict[str, Any]) -> int:
        idle = self.t.udp if s["proto"] == S.UDP else self.t.idle_us
        ends = [s["last_us"] + idle]
        if s["close_at"] >= 0:
            ends.append(s["close_at"])
        if self.t.active_us is not None:
            ends.append(s["start_us"] + self.t.active_us)
        return min(ends)

    def _record(self, key: int, s: dict[str, Any], reason: str) -> tuple:
        a, b = s["initiator"], 1 - s["initiator"]
        ppi = [
            {"ipt": i, "dir": d, "size": z, "push": p}
            for i, d, z, p in zip(s["ipt"], s["dir"], s["size"], s["push"], strict=True)
        ]
        return (
            key, s["flow_id"], s["proto"], s["start_us"], s["last_us"], a, s["n"][a], s["n"][b], s["b"][a], s["b"][b], s["flags"],
            s["jumps"], reason, ppi, len(ppi),
        )

    def _add(self, s: dict[str, Any] | None, r: Any) -> dict[str, Any]:
        ts, side = int(r.ts_us), int(r.side)
        if s is None:
            s = {
                "flow_id": int(r.pkt_id), "proto": int(r.proto), "start_us": ts, "last_us": ts, "initiator": side, "n": [0, 0],
                "b": [0, 0], "flags": 0, "fin": 0, "close_at": -1, "pay_us": ts, "jumps": 0, "ipt": [], "dir": [], "size": [], "push": [],
            }
        s["jumps"] += int(ts < s["last_us"])
        s["last_us"] = max(s["last_us"], ts)
        s["n"][side] += 1
        s["b"][side] += int(r.payload_len)
        s["flags"] |= int(r.flags)
        if r.payload_len > 0 and len(s["ipt"]) < S.K_MAX:
            gap = (ts - s["pay_us"]) / self.t.ipt_unit_us if s["ipt"] else 0.0
            s["ipt"].append(min(int(gap + 0.5), S.IPT_MAX) if gap > 0 else 0)
            s["dir"].append(1 if side == s["initiator"] else -1)
            s["size"].append(min(int(r.payload_len), S.SIZE_MAX))
            s["push"].append(int(bool(int(r.flags) & S.PSH)))
            s["pay_us"] = ts
        if r.proto == S.TCP and int(r.flags) & S.FIN and self.t.linger_us is not None:
            s["fin"] |= 1 << side
            if s["fin"] == 3:
                s["close_at"] = ts + self.t.linger_us
        return s

    def _load(self, key: int) -> dict[str, Any] | None:
        got = self.state.getValue((key,))
        if got is None:
            return None
        names = [c.split()[0] for c in STATE.split(", ")]
        s = dict(zip(names, got, strict=True))
        return {k: list(v) if hasattr(v, "__len__") and not isinstance(v, str) else v for k, v in s.items()}

    def _save(self, key: int, s: dict[str, Any] | None, known: bool = True) -> None:
        if self.timers:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        if s is None:
            if known:
                self.state.removeKey((key,))
            return
        self.state.updateValue((key,), tuple(s.values()))
        if self.timers:
            self.handle.registerTimer(self._expiry(s) // 1000 + 1)

    def _closed(self, key: int, s: dict[str, Any] | None, packets: Iterator[Packet]) -> Iterator[tuple]:
        """The flows of a key that close among its packets; what is open at the end is saved."""
        known = s is not None
        for r in packets:
            if s is not None:
                reason = self._reason(s, r.ts_us)
                if reason is None and r.proto == FLUSH:
                    reason = "fin" if s["fin"] == 3 else "eof"
                if reason is not None:
                    yield self._record(key, s, reason)
                    s = None
            if r.proto == FLUSH:
                continue
            s = self._add(s, r)
            if r.proto == S.TCP and r.flags & S.RST:
                yield self._record(key, s, "rst")
                s = None
        self._save(key, s, known)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        out: list[tuple] = []
        for own, packets in groupby(self._ordered(rows), key=lambda p: p.flow_key):
            for flow in self._closed(own, self._load(own), packets):
                out.append(flow)
                if len(out) == self.piece:
                    yield pd.DataFrame(out, columns=_COLUMNS)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        own = int(key[0])
        s = self._load(own)
        if s is None:
            return
        reason = self._reason(s, expiredTimerInfo.getExpiryTimeInMs() * 1000)
        if reason is not None:
            out = [self._record(own, s, reason)]
            self._save(own, None)
            yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def _in_time(packets: np.ndarray) -> np.ndarray:
    return packets[np.lexsort((packets[:, 2], packets[:, 1], packets[:, 0]))]


def _cut(packets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    return (packets[i : i + size] for i in range(0, len(packets), size))


def flow_stream(
    packets: DataFrame, timeouts: Timeouts, timers: bool = True, watermark: str = "1 minute", held: int = HELD_ROWS, piece: int = PIECE_ROWS
) -> DataFrame:
    """Closed flows of a packet stream with ``event_time``. Of one group of keys a task holds about ``held`` rows of a
    batch. With ``timers`` every key is a group of its own, as each has its own expiry."""
    rows = packets.withWatermark("event_time", watermark) if timers else packets
    group = F.col("flow_key") if timers else F.pmod(F.xxhash64("flow_key"), F.lit(GROUPS))
    return rows.withColumn("flow_group", group).groupBy("flow_group").transformWithStateInPandas(
        statefulProcessor=FlowProcessor(timeouts, timers, held, piece), outputStructType=FLOWS, outputMode="Append",
        timeMode="EventTime" if timers else "None",
    )


def with_flush(packets: DataFrame) -> DataFrame:
    """Add one closing row per key at the end of the capture."""
    end = packets.agg(F.max("ts_us").alias("ts_us"), F.max("event_time").alias("event_time"))
    rows = packets.select("flow_key").distinct().crossJoin(F.broadcast(end)).select(
        "flow_key", "ts_us", F.lit(2**62).alias("pkt_id"), F.lit(0).alias("side"), F.lit(FLUSH).alias("proto"),
        F.lit(0).cast("bigint").alias("payload_len"), F.lit(0).alias("flags"), "event_time",
    )
    return packets.select(*PACKETS.fieldNames()).unionByName(rows)


def idle_sessions(events: DataFrame, key: str, gap: str, watermark: str | None = None) -> DataFrame:
    """Idle-only flows as session windows; batch or stream."""
    rows = events if watermark is None else events.withWatermark("event_time", watermark)
    return rows.groupBy(key, F.session_window("event_time", gap)).agg(F.count("*").alias("n")).select(
        key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n"
    )


def time_windows(events: DataFrame, width: str, slide: str | None = None, watermark: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Tumbling (or sliding) counts; batch or stream."""
    rows = events if watermark is None else events.withWatermark("event_time", watermark)
    win = F.window("event_time", width, slide) if slide else F.window("event_time", width)
    return rows.groupBy(win, *by).agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n"
    )
