"""Keys that hold too many packets for one task.

A hot key's packets are cut into time chunks of a bounded number of rows. Every chunk is a window
partition of its own, and a table with one row per (key, chunk) carries what a chunk has to know
about its neighbours: the latest time before it, the sums before it, the first packet after it.

Active and FIN closing: the first packet of the next flow is a function of the first packet of
the current one, ``nxt(p)``. It is looked up for all packets at once, and the flow starts are the
packets reached from the segment's first packet. They are found by pointer doubling, in
log2(flows per segment) rounds, instead of a walk in one task.

In arrival order a clock may step back, so time ranges say nothing. There a hot key is cut into ranges of
arrival. Every chunk is read as a stream from the state its predecessor leaves, which is first taken to be
none; chunks whose predecessor leaves another state are read again until nothing changes, in runs of twice as many
chunks each time that hand their states on, so a key of n chunks takes log2(n) rounds at most. A flow that begins
inside a chunk makes what the chunk leaves independent of what it got, so few are read twice.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from flowtide import schema as S
from flowtide.bindings import Timeouts
from flowtide.operators.ordered import global_row_number
from flowtide.session import cut

#: time slots a hot key's histogram has per ``hot_rows`` packets
SLOTS_PER_CHUNK = 64


def hot_keys(packets: DataFrame, hot_rows: int) -> DataFrame | None:
    """Keys above ``hot_rows`` packets with their time slots, or None when there are none.

    No key can be hot when the whole table is small, and counting a Parquet scan reads no column.
    The result has at most rows/hot_rows keys and 64 integers per ``hot_rows`` packets.
    """
    if packets.count() <= hot_rows:
        return None
    stats = (
        packets.groupBy("flow_key")
        .agg(F.count("*").alias("n"), F.min("ts_us").alias("t0"), F.max("ts_us").alias("t1"))
        .where(F.col("n") > hot_rows)
    )
    stats = cut(
        stats.withColumn("slots", F.ceil(F.col("n") / hot_rows) * SLOTS_PER_CHUNK).withColumn(
            "slot_us",
            F.greatest(F.lit(1), F.ceil((F.col("t1") - F.col("t0") + 1) / F.col("slots"))),
        )
    )
    if stats.isEmpty():
        return None
    filled = (
        packets.join(F.broadcast(stats), "flow_key")
        .groupBy("flow_key", F.floor((F.col("ts_us") - F.col("t0")) / F.col("slot_us")).alias("slot"))
        .agg(F.count("*").alias("c"))
    )
    before = W.partitionBy("flow_key").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    chunks = filled.withColumn(
        "chunk",
        F.floor(F.coalesce(F.sum("c").over(before), F.lit(0)) / F.lit(max(hot_rows // 4, 1))),
    )
    # slots without packets take the chunk of the last filled slot before them
    every = stats.select(
        "flow_key", F.explode(F.expr("sequence(0L, slots - 1)")).alias("slot")
    ).join(chunks.drop("c"), ["flow_key", "slot"], "left")
    upto = W.partitionBy("flow_key").orderBy("slot").rowsBetween(W.unboundedPreceding, 0)
    every = every.withColumn("chunk", F.coalesce(F.last("chunk", ignorenulls=True).over(upto), F.lit(0)))
    per_key = every.groupBy("flow_key").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("slot", "chunk"))), lambda e: e["chunk"]
        ).alias("slot_chunk")
    )
    return cut(
        stats.join(per_key, "flow_key").select("flow_key", "t0", "t1", "slot_us", "slot_chunk")
    )


def chunk_of(time: Column) -> Column:
    slot = F.floor(
        (F.least(F.greatest(time, F.col("t0")), F.col("t1")) - F.col("t0")) / F.col("slot_us")
    )
    return F.get("slot_chunk", slot.cast("int"))


def _in_chunks(rows: DataFrame, keys: DataFrame, time: Column) -> DataFrame:
    """Rows of hot keys with the ``chunk`` of a time. The slots of a key do not travel with its rows."""
    return rows.join(F.broadcast(keys), "flow_key").withColumn("chunk", chunk_of(time)).drop(*[c for c in keys.columns if c != "flow_key"])


def _fill(
    rows: DataFrame, value: Column, name: str, order: Sequence[Column], key: Sequence[str], forward: bool
) -> DataFrame:
    """Last (forward) or first (backward) non-null ``value`` strictly before/after each row.

    One window inside the chunk, one window over the (key, chunk) summary.
    """
    key = list(key)
    rows = rows.withColumn("_v", value)
    at = F.struct(*order)
    pick = F.max_by if forward else F.min_by
    edge = rows.groupBy(*key, "chunk").agg(pick("_v", F.when(F.col("_v").isNotNull(), at)).alias("_e"))
    over = W.partitionBy(*key).orderBy(F.col("chunk").asc() if forward else F.col("chunk").desc())
    carry = edge.select(
        *key,
        "chunk",
        F.last("_e", ignorenulls=True).over(over.rowsBetween(W.unboundedPreceding, -1)).alias("_c"),
    )
    inner = W.partitionBy(*key, "chunk").orderBy(*[c.asc() if forward else c.desc() for c in order])
    return (
        rows.join(carry, [*key, "chunk"], "left")
        .withColumn(
            name,
            F.coalesce(
                F.last("_v", ignorenulls=True).over(inner.rowsBetween(W.unboundedPreceding, -1)),
                F.col("_c"),
            ),
        )
        .drop("_v", "_c")
    )


def _running_sum(rows: DataFrame, value: Column, name: str, order: Sequence[Column], key: Sequence[str]) -> DataFrame:
    key = list(key)
    rows = rows.withColumn("_v", value)
    per = rows.groupBy(*key, "chunk").agg(F.sum("_v").alias("_s"))
    carry = per.select(
        *key,
        "chunk",
        F.coalesce(
            F.sum("_s").over(
                W.partitionBy(*key).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_c"),
    )
    inner = W.partitionBy(*key, "chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        rows.join(carry, [*key, "chunk"], "left")
        .withColumn(name, F.sum("_v").over(inner) + F.col("_c"))
        .drop("_v", "_c")
    )


def assemble_hot(
    packets: DataFrame, keys: DataFrame, t: Timeouts, order: Sequence[str], hot_rows: int
) -> DataFrame:
    """Per-side flow rows (as ``assemble.flow_rows``) of the hot keys only.

    For packets in time order: a chunk is a time range.
    """
    from flowtide.operators.assemble import flow_rows, has_flag, idle_limit

    key = ["flow_key"]
    at = [F.col(c) for c in ("ts_us", "pkt_id")]
    me = F.struct(*at)
    rows = _in_chunks(packets, keys, F.col("ts_us"))
    rows = _fill(rows, F.struct("ts_us", has_flag(S.RST).alias("rst")), "prev", at, key, True)
    rows = _fill(rows, F.col("ts_us"), "next_ts", at, key, False)
    hard = (
        F.col("prev").isNull()
        | F.col("prev.rst")
        | (F.col("ts_us") - F.col("prev.ts_us") >= idle_limit(t))
    )
    rows = cut(_running_sum(rows.withColumn("hard", hard), F.col("hard").cast("bigint"), "seg_no", at, key))
    starts = rows.where("hard").select("flow_key", "seg_no", me.alias("start"))
    if t.active_us is not None or t.linger_us is not None:
        starts = _reached(starts, _next_start(rows, keys, t, at, key))
    marks = starts.select("flow_key", F.col("start.ts_us").alias("ts_us"), F.col("start.pkt_id").alias("pkt_id"))
    rows = rows.join(marks.withColumn("is_start", F.lit(1)), ["flow_key", "ts_us", "pkt_id"], "left")
    flow_key = [*key, "flow_no"]
    rows = cut(_running_sum(rows, F.coalesce("is_start", F.lit(0)).cast("bigint"), "flow_no", at, key))

    # the first 30 payload packets: a row number below a limit is cut before it is shuffled
    pay = rows.where(F.col("payload_len") > 0)
    w = W.partitionBy(*flow_key).orderBy(*at)
    first = pay.withColumn("pay_rank", F.row_number().over(w)).where(F.col("pay_rank") <= S.K_MAX)
    first = first.withColumn("pay_prev_ts", F.lag("ts_us").over(w))
    totals = flow_rows(
        rows.withColumn("jump", F.lit(0))
        .withColumn("pay_rank", F.lit(S.K_MAX + 1))
        .withColumn("pay_prev_ts", F.lit(None).cast("bigint")),
        flow_key,
        t,
        order,
    )
    heads = flow_rows(first.withColumn("jump", F.lit(0)), flow_key, t, order).select(*flow_key, F.col("_ppi").alias("_head"))
    return (
        totals.join(heads, flow_key, "left")
        .withColumn("_ppi", F.coalesce("_head", "_ppi"))
        .drop("_head")
    )


def _next_start(rows: DataFrame, keys: DataFrame, t: Timeouts, at: Sequence[Column], key: Sequence[str]) -> DataFrame:
    """``nxt`` per packet: the packet that would start the next flow of the same segment."""
    from flowtide.operators.assemble import has_flag

    me = F.struct(*at)
    cols = ["flow_key", "seg_no", "ts_us", "pkt_id"]
    base = rows.select(*cols, "chunk", "side", has_flag(S.FIN).alias("fin"))
    options = []
    if t.linger_us is not None:
        # a packet a linger after the latest FIN before it can end a both-FIN flow
        base = _fill(base, F.when(F.col("fin"), F.col("ts_us")), "fin_before", at, key, True)
        gap = F.col("ts_us") - F.col("fin_before") >= t.linger_us
        base = _fill(base, F.when(gap, F.struct("seg_no", *at)), "gap_after", at, key, False)
        for s in (0, 1):
            mine = F.col("fin") & (F.col("side") == s)
            # gap_after of the next FIN of this side, the packet itself included
            seen = F.when(mine, F.struct(F.col("seg_no"), F.col("gap_after").alias("g")))
            base = _fill(base, seen, f"fin_{s}", at, key, False)
            base = base.withColumn(f"fin_{s}", F.coalesce(seen, f"fin_{s}"))
        inside = lambda c: F.when(F.col(f"{c}.seg_no") == F.col("seg_no"), F.col(f"{c}.g"))
        g0, g1 = inside("fin_0"), inside("fin_1")
        later = F.when(g0.isNotNull() & g1.isNotNull(), F.greatest(g0, g1))
        options.append(
            F.when(
                later["seg_no"] == F.col("seg_no"),
                F.struct(later["ts_us"].alias("ts_us"), later["pkt_id"].alias("pkt_id")),
            )
        )
    if t.active_us is not None:
        # probes at start + active, sorted before packets of the same time
        packets = base.withColumn("kind", F.lit(1)).withColumn("time", F.col("ts_us"))
        probes = packets.withColumn("kind", F.lit(0)).withColumn("time", F.col("ts_us") + t.active_us)
        both = packets.unionByName(_in_chunks(probes.drop("chunk"), keys, F.col("time")))
        line = [F.col("time"), F.col("kind"), F.col("pkt_id")]
        found = _fill(
            both, F.when(F.col("kind") == 1, F.struct("seg_no", "ts_us", "pkt_id")), "hit", line, key, False
        )
        base = found.where("kind = 0")
        options.append(
            F.when(
                F.col("hit.seg_no") == F.col("seg_no"),
                F.struct(F.col("hit.ts_us").alias("ts_us"), F.col("hit.pkt_id").alias("pkt_id")),
            )
        )
    nxt = F.least(*options) if len(options) > 1 else options[0]
    return cut(base.select("flow_key", "seg_no", me.alias("p"), nxt.alias("nxt")).where("nxt is not null"))


def _reached(starts: DataFrame, pointer: DataFrame) -> DataFrame:
    """Packets on the chains from the segment starts, by pointer doubling."""
    seen = cut(starts)
    n = seen.count()
    while True:
        step = seen.join(
            pointer.select("flow_key", "seg_no", F.col("p").alias("start"), "nxt"),
            ["flow_key", "seg_no", "start"],
        ).select("flow_key", "seg_no", F.col("nxt").alias("start"))
        seen = cut(seen.unionByName(step).distinct())
        now = seen.count()
        if now == n:
            return seen
        n = now
        ahead = pointer.select("flow_key", "seg_no", F.col("p").alias("nxt"), F.col("nxt").alias("nxt2"))
        pointer = cut(
            pointer.join(ahead, ["flow_key", "seg_no", "nxt"]).select(
                "flow_key", "seg_no", "p", F.col("nxt2").alias("nxt")
            )
        )


#: what a chunk leaves to the next: the open flow of the key, and the chunk and number it is called by
STATE = "rst boolean, start bigint, last bigint, fin int, close_at bigint, n_pay bigint, pay_ts bigint, o_chunk int, o_no bigint"
STATE_NAMES = [c.split()[0] for c in STATE.split(", ")]
_MADE = [("o_chunk", T.IntegerType(), pa.int32()), ("o_no", T.LongType(), pa.int64()), ("pay_rank", T.LongType(), pa.int64()),
         ("pay_prev_ts", T.LongType(), pa.int64()), ("jump", T.IntegerType(), pa.int32())]


class ChunkFold:
    """Flows of one chunk of a key in arrival order, from the state before it."""

    def __init__(self, t: Timeouts, chunk: int, state: dict | None) -> None:
        from flowtide.operators.assemble import Fold

        self.flow, self.chunk, self.made = Fold(t), chunk, 0
        self.fresh, self.name = True, (chunk, 0)
        if state is not None:
            f = self.flow
            f.no, f.start, f.last, f.fin, f.close_at, f.n_pay, f.pay_ts = 0, *(state[c] for c in STATE_NAMES[1:7])
            self.fresh, self.name = state["rst"], (state["o_chunk"], state["o_no"])

    def add(self, now: int, side: int, flags: int, proto: int, payload: int) -> tuple:
        """(chunk and number of the flow, payload rank, time of the payload packet before, time went backwards)."""
        before = self.flow.no
        no, rank, prev, jump = self.flow.add(self.fresh, now, side, flags, proto, payload)
        if self.fresh or no != before:
            self.name, self.made = (self.chunk, self.made), self.made + 1
        self.fresh = proto == S.TCP and bool(flags & S.RST)
        return (*self.name, rank, prev, jump)

    def state(self) -> tuple:
        f = self.flow
        return (self.fresh, f.start, f.last, f.fin, f.close_at, f.n_pay, f.pay_ts, *self.name)


def _state_type() -> str:
    return f"struct<{STATE.replace(' ', ':').replace(',:', ',')}>"


def _left_states(rows: DataFrame, t: Timeouts, order: Sequence[str]) -> DataFrame:
    """(flow_key, chunk, got, left): the state every chunk leaves, read run by run.

    ``rows`` has ``chunk``, ``run`` and the state before the first chunk of a run, ``due``; inside a run the states are
    handed on. A chunk that gets what it got before (``got``) leaves what it left (``left``) and is passed over. A run
    lies in one partition and is read as a stream.
    """
    state = T._parse_datatype_string(_state_type())
    schema = T.StructType([*[f for f in rows.schema.fields if f.name in ("flow_key", "chunk")], T.StructField("got", state), T.StructField("left", state)])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        left: dict | None = None
        here: tuple | None = None
        fold: ChunkFold | None = None
        got: dict | None = None
        kinds = None

        def close() -> dict:
            nonlocal left
            if fold is not None:
                left = dict(zip(STATE_NAMES, fold.state(), strict=True))
            return dict(zip(names, (here[0], here[2], got, left), strict=True))

        for b in batches:
            if not b.num_rows:
                continue
            kinds = pa.schema([b.schema.field("flow_key"), b.schema.field("chunk"), pa.field("got", b.schema.field("due").type), pa.field("left", b.schema.field("due").type)])
            out = []
            cols = [b.column(c).to_pylist() for c in ("flow_key", "run", "chunk", "ts_us", "side", "flags", "proto", "payload_len")]
            for i, (key, no, chunk, *packet) in enumerate(zip(*cols, strict=True)):
                if (key, no, chunk) != here:
                    if here is not None:
                        out.append(close())
                    here = (key, no, chunk)
                    got = left if (key, no) == at else b.column("due")[i].as_py()
                    at = (key, no)
                    same = b.column("left")[i].is_valid and b.column("got")[i].as_py() == got
                    fold, left = (None, b.column("left")[i].as_py()) if same else (ChunkFold(t, chunk, got), None)
                if fold is not None:
                    fold.add(*packet)
            if out:
                yield pa.RecordBatch.from_pylist(out, kinds)
        if here is not None:
            yield pa.RecordBatch.from_pylist([close()], kinds)

    dealt = rows.repartition("flow_key", "run").sortWithinPartitions("flow_key", "run", "chunk", *order)
    return dealt.mapInArrow(run, schema)


def _chunk_folds(rows: DataFrame, t: Timeouts, order: Sequence[str]) -> DataFrame:
    """``rows`` (with ``chunk`` and the state before it, ``got``) read chunk by chunk: packets with flow names and ranks."""
    names = [c for c in rows.columns if c != "got"]
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != "got"], *[T.StructField(n, k) for n, k, _ in _MADE]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, here = None, None
        for b in batches:
            if not b.num_rows:
                continue
            out = []
            cols = [b.column(c).to_pylist() for c in ("flow_key", "chunk", "ts_us", "side", "flags", "proto", "payload_len")]
            for i, (key, chunk, *packet) in enumerate(zip(*cols, strict=True)):
                if (key, chunk) != here:
                    here = (key, chunk)
                    fold = ChunkFold(t, chunk, b.column("got")[i].as_py())
                out.append(fold.add(*packet))
            extra = [pa.array(c, k) for c, (_, _, k) in zip(zip(*out, strict=True), _MADE, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *extra], names=[*names, *[n for n, _, _ in _MADE]])

    # a chunk lies in one partition
    return rows.repartition("flow_key", "chunk").sortWithinPartitions("flow_key", "chunk", *order).mapInArrow(run, schema)


def hot_in_arrival(packets: DataFrame, hot_rows: int) -> DataFrame | None:
    """Keys above ``hot_rows`` packets, at most rows / hot_rows of them, or None."""
    if packets.count() <= hot_rows:
        return None
    keys = cut(packets.groupBy("flow_key").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows))
    return None if keys.isEmpty() else keys


def assemble_arrival(packets: DataFrame, keys: DataFrame, t: Timeouts, order: Sequence[str], hot_rows: int) -> DataFrame:
    """Per-side flow rows (as ``assemble.flow_rows``) of the hot keys only, in arrival order."""
    from flowtide.operators.assemble import flow_rows

    hot = packets.join(F.broadcast(keys.select("flow_key")), "flow_key")
    placed = global_row_number(hot, order, "_at", ["flow_key"])
    rows = cut(placed.withColumn("chunk", F.floor((F.col("_at") - 1) / max(hot_rows // 4, 1)).cast("int")).drop("_at", "_at_total"))
    none = F.lit(None).cast(_state_type())
    by_key = W.partitionBy("flow_key").orderBy("chunk")

    alone = rows.withColumns({"run": F.col("chunk"), "due": none, "got": none, "left": none})
    states = cut(_left_states(alone, t, order))
    span = 1
    while True:
        linked = states.withColumn("due", F.lag("left").over(by_key))
        stale = cut(linked.where(~F.col("due").eqNullSafe(F.col("got"))).select("flow_key", "chunk", "due"))
        if stale.isEmpty():
            break
        # runs of twice as many chunks each time: only a run's first chunk can be given another state afterwards
        span *= 2
        run = F.floor(F.col("chunk") / span).cast("bigint")
        first = stale.groupBy("flow_key", run.alias("run")).agg(F.min("chunk").alias("_from"), F.min_by("due", "chunk").alias("due"))
        again = states.withColumn("run", run).join(first, ["flow_key", "run"]).where(F.col("chunk") >= F.col("_from")).drop("_from")
        again = cut(again)
        made = _left_states(rows.join(again, ["flow_key", "chunk"]), t, order)
        states = cut(states.join(again.select("flow_key", "chunk"), ["flow_key", "chunk"], "left_anti").unionByName(made))
    firsts = rows.groupBy("flow_key", "chunk").agg(F.min_by("ts_us", F.struct(*order)).alias("_first"))
    following = firsts.select("flow_key", "chunk", F.lead("_first").over(by_key).alias("_after"))
    known = states.select("flow_key", "chunk", "got").join(following, ["flow_key", "chunk"])
    named = _chunk_folds(rows.join(known, ["flow_key", "chunk"]), t, order)
    in_chunk = W.partitionBy("flow_key", "chunk").orderBy(*order)
    named = named.withColumn("next_ts", F.coalesce(F.lead("ts_us").over(in_chunk), "_after")).drop("_after")
    return flow_rows(named, ["flow_key", "o_chunk", "o_no"], t, order)
