"""Damage and augmentation of packet sequences, as projections of the flow's own array.

A draw is a uniform number that depends on (purpose, flow, position) only, so the result is the
same under any partitioning. ``draw(purpose, position)`` is handed in; ``hash_draw`` is the default
choice, ``arith_draw`` can be repeated by another SQL engine.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide import schema as S
from flowtide.functions import draws as R
from flowtide.functions import ppi as P

Draw = Callable[[str, Column], Column]


def hash_draw(seed: int, key: Column) -> Draw:
    return lambda purpose, j: R.uniform(seed, purpose, key, j)


def arith_draw(seed: int, key: Column) -> Draw:
    return lambda purpose, j: R.lcg_uniform(seed, purpose, key * 64 + j)


def _normal(draw: Draw, purpose: str, j: Column) -> Column:
    u1 = F.greatest(draw(purpose + "/r", j), F.lit(2.0**-31))
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * draw(purpose + "/a", j))


def _packet(ipt: Column, p: Column, size: Column | None = None) -> Column:
    return F.struct(
        ipt.cast("int").alias("ipt"), p["dir"].alias("dir"),
        (p["size"] if size is None else size.cast("int")).alias("size"), p["push"].alias("push"),
    )


EMPTY = "array<struct<ipt:int,dir:int,size:int,push:int>>"


def drop_with_mask(ppi: Column, keep: Column) -> Column:
    """Keep the packets where ``keep`` is true. A dropped packet's gap goes to the next survivor,
    the first survivor has gap 0."""
    start = F.struct(F.lit(0).alias("carry"), F.array().cast(EMPTY).alias("out"))

    def step(acc: Column, e: Column) -> Column:
        p = e["p"]
        gap = F.least(F.greatest(p["ipt"] + acc["carry"], F.lit(0)), F.lit(S.IPT_MAX))
        first = F.size(acc["out"]) == 0
        kept = F.concat(acc["out"], F.array(_packet(F.when(first, F.lit(0)).otherwise(gap), p)))
        return F.struct(
            F.when(e["k"], F.lit(0)).otherwise(acc["carry"] + p["ipt"]).alias("carry"),
            F.when(e["k"], kept).otherwise(acc["out"]).alias("out"),
        )

    pairs = F.zip_with(ppi, keep, lambda p, k: F.struct(p.alias("p"), k.alias("k")))
    return F.aggregate(pairs, start, step)["out"]


def keep_mask(ppi: Column, p: float | Column, draw: Draw) -> Column:
    """True with probability 1 - p per packet; a flow never loses every packet."""
    p = F.lit(float(p)) if not isinstance(p, Column) else p
    n = F.size(ppi)
    mask = F.transform(ppi, lambda x, j: draw("drop", j) >= p)
    saved = F.least(F.floor(draw("drop/rescue", F.lit(0)) * n), n - 1)
    return F.when(F.exists(mask, lambda k: k), mask).otherwise(
        F.transform(ppi, lambda x, j: j.cast("bigint") == saved)
    )


def drop(ppi: Column, p: float | Column, draw: Draw) -> Column:
    return drop_with_mask(ppi, keep_mask(ppi, p, draw))


def swap_neighbours(ppi: Column, q: float | Column, draw: Draw) -> Column:
    """Left to right: swap packet i with i + 1 with probability q, then skip both."""
    q = F.lit(float(q)) if not isinstance(q, Column) else q
    n = F.size(ppi)
    wants = F.transform(ppi, lambda x, j: (draw("swap", j) < q) & (j < n - 1))
    start = F.array().cast("array<boolean>")
    swaps = F.aggregate(
        wants, start,
        lambda acc, w: F.concat(acc, F.array(w & ~F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(False)))),
    )
    marked = F.zip_with(ppi, swaps, lambda p, s: F.struct(p.alias("p"), s.alias("s")))
    lead = F.concat(F.slice(marked, F.lit(2), n), F.array(F.lit(None).cast("struct<p:struct<ipt:int,dir:int,size:int,push:int>,s:boolean>")))
    lag = F.concat(F.array(F.lit(None).cast("struct<p:struct<ipt:int,dir:int,size:int,push:int>,s:boolean>")), marked)
    three = F.arrays_zip(marked.alias("m"), lead.alias("n"), F.slice(lag, F.lit(1), n).alias("b"))
    moved = F.transform(
        three,
        lambda e: F.when(e["m"]["s"], e["n"]["p"]).when(F.coalesce(e["b"]["s"], F.lit(False)), e["b"]["p"]).otherwise(e["m"]["p"]),
    )
    return F.transform(moved, lambda p, j: _packet(F.when(j == 0, F.lit(0)).otherwise(p["ipt"]), p))


def jitter_gaps(ppi: Column, s: float | Column, draw: Draw) -> Column:
    """Gaps times exp(s N(0, 1)), rounded half up and capped; the first stays 0."""
    s = F.lit(float(s)) if not isinstance(s, Column) else s
    return F.transform(
        ppi,
        lambda p, j: _packet(
            F.when(j == 0, F.lit(0)).otherwise(P.clip_ipt(p["ipt"] * F.exp(s * _normal(draw, "ipt", j)))), p
        ),
    )


def jitter_sizes(ppi: Column, sd: float | Column, draw: Draw) -> Column:
    """Sizes plus N(0, sd), rounded half even, kept in 1..1500."""
    sd = F.lit(float(sd)) if not isinstance(sd, Column) else sd
    return F.transform(
        ppi,
        lambda p, j: _packet(
            p["ipt"], p,
            F.least(F.greatest(F.bround(p["size"] + sd * _normal(draw, "size", j)), F.lit(1.0)), F.lit(float(S.SIZE_MAX))),
        ),
    )


def random_crop(ppi_len: Column, draw: Draw) -> Column:
    """K uniform in 2..30, at most the length."""
    k = F.floor(draw("crop", F.lit(0)) * 29).cast("int") + 2
    return F.least(k, F.greatest(ppi_len, F.lit(1)))


def prefix_crop(ppi_len: Column, draw: Draw, low: int = 3) -> tuple[Column, Column]:
    """(k, eligible): K uniform in low..min(30, len - 1); too short flows keep their length."""
    high = F.least(F.lit(S.K_MAX), ppi_len - 1)
    ok = high >= low
    span = F.greatest(high - low + 1, F.lit(1))
    k = F.floor(draw("prefix-crop", F.lit(0)) * span).cast("int") + low
    return F.when(ok, k).otherwise(ppi_len), ok


def position_mask(ppi: Column, fraction: float, draw: Draw) -> Column:
    """Marks max(1, round(fraction * len)) random positions (rounding half even)."""
    n = F.greatest(F.lit(1), F.bround(F.size(ppi) * F.lit(float(fraction)))).cast("int")
    scored = F.transform(ppi, lambda p, j: F.struct(draw("mask", j).alias("u"), j.alias("j")))
    chosen = F.transform(F.slice(F.array_sort(scored), F.lit(1), n), lambda e: e["j"])
    return F.transform(ppi, lambda p, j: F.array_contains(chosen, j))


# --- named conditions -------------------------------------------------------------------------


class Rule(NamedTuple):
    """What a kind of damage does to a sequence, and the range of the number it takes (None: it takes none)."""

    apply: Callable[[Column, float | None, Draw], Column]
    top: float | None = None


RULES = {
    "clean": Rule(lambda ppi, _, draw: F.transform(ppi, lambda p: _packet(p["ipt"], p))),
    "drop": Rule(drop, 1.0),
    "reorder": Rule(swap_neighbours, 1.0),
    "ipt_jitter": Rule(jitter_gaps, math.inf),
    "size_jitter": Rule(jitter_sizes, math.inf),
}
UNDAMAGED = {"name": "clean", "kind": "clean"}


def _fault(entry: Mapping) -> str | None:
    """What is wrong with an entry {name, kind, value}, or None."""
    rule, value, name = RULES.get(entry.get("kind")), entry.get("value"), entry.get("name")
    if rule is None:
        return f"kinds are {', '.join(RULES)}"
    if not set(entry) <= {"name", "kind", "value"}:
        return "an entry has name, kind and value"
    if rule.top is None:
        usable = value is None
    else:
        usable = value is not None and 0 <= value <= rule.top
    if not usable:
        return "takes no value" if rule.top is None else f"takes a value from 0 to {rule.top}"
    if not name or set(name) & set("/\\"):
        return "names are used as folder names"
    return "this name is kept for undamaged flows" if name == UNDAMAGED["name"] and entry["kind"] != "clean" else None


def conditions(entries: Sequence[Mapping]) -> dict[str, tuple[Rule, float | None]]:
    """Checked entries by name, the undamaged condition first."""
    faults = [f"{e}: {why}" for e in entries if (why := _fault(e))]
    if faults:
        raise ValueError("; ".join(faults))
    named = {e["name"]: e for e in (UNDAMAGED, *entries)}
    if len(named) != len([e for e in entries if e["name"] != UNDAMAGED["name"]]) + 1:
        raise ValueError("two conditions have the same name")
    return {name: (RULES[e["kind"]], e.get("value")) for name, e in named.items()}


def damage(flows: DataFrame, conds: Mapping[str, tuple[Rule, float | None]], make_draw: Callable[[str], Draw]) -> DataFrame:
    """Every flow under every condition: adds ``condition``, replaces ``ppi`` and ``ppi_len``.

    ``make_draw(name)`` gives the draws of one condition. One narrow pass over the flows.
    """
    keep = [c for c in flows.columns if c not in ("ppi", "ppi_len")]
    forms = [
        F.struct(F.lit(name).alias("condition"), rule.apply(F.col("ppi"), value, make_draw(name)).alias("ppi"))
        for name, (rule, value) in conds.items()
    ]
    rows = flows.select(*keep, F.explode(F.array(*forms)).alias("d"))
    return rows.select(*keep, "d.condition", "d.ppi", F.size("d.ppi").alias("ppi_len"))
