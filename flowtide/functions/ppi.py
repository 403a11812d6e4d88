"""Column expressions over the per-packet array ``ppi ARRAY<STRUCT<ipt, dir, size, push>>``."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowtide import schema as S


def clip_ipt(gap: Column) -> Column:
    """Gap in ipt units to a whole number: half up, never negative, capped."""
    rounded = F.floor(gap + F.lit(0.5)).cast("bigint")
    return (
        F.when(gap <= 0, F.lit(0))
        .otherwise(F.least(rounded, F.lit(S.IPT_MAX).cast("bigint")))
        .cast("int")
    )


def clip_size(size: Column) -> Column:
    return F.least(F.greatest(size, F.lit(0)), F.lit(S.SIZE_MAX)).cast("int")


def edge_bin(value: Column, edges: Sequence[float]) -> Column:
    """Number of edges strictly below the value: bin i holds (edge[i-1], edge[i]]."""
    out = F.lit(0)
    for e in edges:
        out = out + (value > F.lit(e)).cast("int")
    return out


def packed_histogram(
    ppi: Column, value: Callable[[Column], Column], edges: Sequence[float], direction: int
) -> Column:
    """Eight bin counts of one direction in one LONG, five bits each (at most 30 packets)."""
    return F.aggregate(
        ppi,
        F.lit(0).cast("bigint"),
        lambda acc, p: acc
        + F.when(
            p["dir"] == direction,
            F.call_function(
                "shiftleft", F.lit(1).cast("bigint"), edge_bin(value(p), edges) * F.lit(5)
            ),
        ).otherwise(F.lit(0).cast("bigint")),
    )


def unpack_bin(packed: Column, i: int) -> Column:
    return F.shiftright(packed, 5 * i).bitwiseAND(F.lit(31).cast("bigint"))


def round_trips(ppi: Column) -> Column:
    """Direction changes between neighbours, halved."""
    n = F.size(ppi)
    changes = F.size(
        F.filter(
            F.zip_with(
                F.slice(ppi, F.lit(1), F.greatest(n - 1, F.lit(0))),
                F.slice(ppi, F.lit(2), F.greatest(n - 1, F.lit(0))),
                lambda a, b: a["dir"] != b["dir"],
            ),
            lambda changed: changed,
        )
    )
    return F.floor(F.when(n < 2, F.lit(0)).otherwise(changes) / 2).cast("bigint")


def total(ppi: Column, field: Callable[[Column], Column]) -> Column:
    return F.aggregate(
        ppi, F.lit(0).cast("bigint"), lambda acc, p: acc + field(p).cast("bigint")
    )


def log_token(value: Column, n_bins: int, top: int) -> Column:
    """Token 1..n_bins of ``n_bins`` geometric bins over [1, top], bins closed on the right.

    The count of interior edges ``top**(i/n)`` strictly below ``v`` is ``ceil(n*ln v/ln top) - 1``,
    so no edge table is searched. ``v = 0`` and ``v = 1`` are in the first bin.
    """
    scaled = F.ceil(F.log(F.greatest(value, F.lit(1)).cast("double")) * F.lit(n_bins / _ln(top)))
    return F.least(F.greatest(scaled, F.lit(1)), F.lit(n_bins)).cast("int")


def _ln(x: float) -> float:
    import math

    return math.log(x)


def token_struct(p: Column) -> Column:
    """One packet as (ipt, dir, size, push) tokens; 0 stays free for padding."""
    ipt = F.least(F.greatest(p["ipt"], F.lit(0)), F.lit(S.IPT_MAX))
    size = F.least(F.greatest(p["size"], F.lit(0)), F.lit(S.SIZE_MAX))
    return F.struct(
        log_token(ipt, S.IPT_TOKENS, S.IPT_MAX).alias("ipt"),
        F.when(p["dir"] == -1, F.lit(2)).otherwise(p["dir"]).alias("dir"),
        log_token(size, S.SIZE_TOKENS, S.SIZE_MAX).alias("size"),
        (p["push"] + 1).alias("push"),
    )


def tokens(ppi: Column) -> Column:
    return F.transform(ppi, token_struct)


def continuous(ppi: Column) -> Column:
    return F.transform(
        ppi,
        lambda p: F.struct(
            (F.log1p(p["size"].cast("double")) * p["dir"]).alias("size_dir"),
            F.log1p(p["ipt"].cast("double")).alias("log_ipt"),
            p["dir"].cast("double").alias("dir"),
            p["push"].cast("double").alias("push"),
        ),
    )


def padding_mask(ppi_len: Column, k: Column | int = S.K_MAX) -> Column:
    """Always 30 wide: position j is real when ``j < min(k, ppi_len)``."""
    cut = F.least(ppi_len, F.lit(k) if isinstance(k, int) else k)
    return F.transform(F.sequence(F.lit(0), F.lit(S.K_MAX - 1)), lambda j: j < cut)


def check_k(k: int) -> int:
    if isinstance(k, bool) or not isinstance(k, int) or not 1 <= k <= S.K_MAX:
        raise ValueError(f"k must be an int in 1..{S.K_MAX}, got {k!r}")
    return k


def prefix(ppi: Column, k: int) -> Column:
    return F.slice(ppi, 1, check_k(k))


def elapsed(ppi: Column, k: Column) -> Column:
    """Sum of the gaps of the first ``k`` packets."""
    return total(F.slice(ppi, F.lit(1), k), lambda p: p["ipt"])


def fill_forward(values: Column, length: Column) -> Column:
    """30 wide: positions past ``length`` repeat the last real value."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(S.K_MAX)),
        lambda j: F.element_at(values, F.least(j, F.greatest(length, F.lit(1))).cast("int")),
    )


def pad_tokens(ppi: Column) -> Column:
    """Fixed-width token view: 30 positions, all-zero structs past the flow's end."""
    zero = F.struct(*[F.lit(0).alias(c) for c in ("ipt", "dir", "size", "push")])
    real = tokens(ppi)
    return F.concat(
        real, F.array_repeat(zero, F.lit(S.K_MAX) - F.least(F.size(ppi), F.lit(S.K_MAX)))
    )
