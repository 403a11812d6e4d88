"""Views of a flow: statistics, tokens, continuous channels, prefixes, standardisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide import schema as S
from flowtide.functions import ppi as P


def _histograms(ppi: Column) -> list[Column]:
    size, ipt = (lambda p: p["size"]), (lambda p: p["ipt"])
    return [
        P.packed_histogram(ppi, size, S.SIZE_EDGES, 1).alias("_h_PSIZE_HIST"),
        P.packed_histogram(ppi, size, S.SIZE_EDGES, -1).alias("_h_PSIZE_HIST_REV"),
        P.packed_histogram(ppi, ipt, S.IPT_EDGES, 1).alias("_h_IPT_HIST"),
        P.packed_histogram(ppi, ipt, S.IPT_EDGES, -1).alias("_h_IPT_HIST_REV"),
    ]


def _unpacked() -> list[Column]:
    return [
        P.unpack_bin(F.col(f"_h_{b}"), i).cast("double").alias(f"{b}_{i}".lower())
        for b in S.HIST_BLOCKS
        for i in range(S.N_BINS)
    ]


def flowstats(flows: DataFrame, keep: Sequence[str] = ("flow_id",)) -> DataFrame:
    """The 46 whole-flow statistics. Counters and flags cover every packet of the flow,
    histograms and sequence sums cover the recorded ones. One narrow projection."""
    unit = 1000.0
    rows = flows.select(
        *keep,
        *[
            F.col(c).cast("double").alias(c)
            for c in ("bytes", "bytes_rev", "packets", "packets_rev")
        ],
        (F.col("duration_units") / F.lit(unit)).alias("duration"),
        F.col("ppi_len").cast("double").alias("_len"),
        P.total(F.col("ppi"), lambda p: p["ipt"]).cast("double").alias("ppi_duration"),
        P.round_trips(F.col("ppi")).cast("double").alias("ppi_roundtrips"),
        *_histograms(F.col("ppi")),
        *[
            (F.col("flags_seen").bitwiseAND(F.lit(bit)) > 0).cast("double").alias(f"flag_{n.lower()}")
            for n, bit in S.FLAG_BITS.items()
        ],
    )
    return rows.select(
        *keep,
        "bytes", "bytes_rev", "packets", "packets_rev", "duration",
        F.col("_len").alias("ppi_len"), "ppi_duration", "ppi_roundtrips",
        *_unpacked(),
        *[f"flag_{n.lower()}" for n in S.FLAG_BITS],
    )


def prefix_flowstats(
    flows: DataFrame, k: int | Column, keep: Sequence[str] = ("flow_id",)
) -> DataFrame:
    """The 46 statistics recomputed from the first ``min(k, ppi_len)`` recorded packets only."""
    cut = k if isinstance(k, Column) else F.lit(P.check_k(k))
    first = flows.where(F.size("ppi") > 0).select(
        *keep, F.slice(F.col("ppi"), F.lit(1), cut).alias("_p")
    )
    p = F.col("_p")
    one_way = lambda d, f: F.aggregate(
        p,
        F.lit(0).cast("bigint"),
        lambda acc, x: acc + F.when(x["dir"] == d, f(x)).otherwise(F.lit(0)).cast("bigint"),
    )
    rows = first.select(
        *keep,
        one_way(1, lambda x: x["size"]).cast("double").alias("bytes"),
        one_way(-1, lambda x: x["size"]).cast("double").alias("bytes_rev"),
        one_way(1, lambda x: F.lit(1)).cast("double").alias("packets"),
        one_way(-1, lambda x: F.lit(1)).cast("double").alias("packets_rev"),
        P.total(p, lambda x: x["ipt"]).cast("double").alias("ppi_duration"),
        F.size(p).cast("double").alias("_len"),
        P.round_trips(p).cast("double").alias("ppi_roundtrips"),
        F.exists(p, lambda x: x["push"] == 1).cast("double").alias("_push"),
        *_histograms(p),
    )
    return _prefix_columns(rows, keep)


def _prefix_columns(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    return rows.select(
        *keep,
        "bytes", "bytes_rev", "packets", "packets_rev",
        (F.col("ppi_duration") / F.lit(1000.0)).alias("duration"),
        F.col("_len").alias("ppi_len"), "ppi_duration", "ppi_roundtrips",
        *_unpacked(),
        *[
            (F.col("_push") if n == "PSH" else F.lit(0.0)).alias(f"flag_{n.lower()}")
            for n in S.FLAG_BITS
        ],
    )


def check_grid(ks: Sequence[int]) -> list[int]:
    """A K grid is non-empty, inside 1..30, without repeats; returned sorted."""
    grid = [P.check_k(k) for k in ks]
    if not grid or len(set(grid)) != len(grid):
        raise ValueError(f"K grid must be non-empty without repeats, got {ks!r}")
    return sorted(grid)


def _running_stats(ppi: Column) -> Column:
    """The statistics before the first packet and after each one, as an array: one pass over the packets."""
    zero = F.lit(0).cast("bigint")
    sums = ["bytes", "bytes_rev", "packets", "packets_rev", "ppi_duration", "_turns", "_push", *[f"_h_{b}" for b in S.HIST_BLOCKS]]
    start = F.struct(*[zero.alias(n) for n in sums], F.lit(None).cast("int").alias("_dir"))

    def step(states: Column, p: Column) -> Column:
        now = F.element_at(states, -1)
        one_way = {"": p["dir"] == 1, "_rev": p["dir"] == -1}
        add = {f"bytes{d}": F.when(c, p["size"]) for d, c in one_way.items()}
        add |= {f"packets{d}": F.when(c, F.lit(1)) for d, c in one_way.items()}
        add |= {"ppi_duration": p["ipt"], "_turns": F.when(p["dir"] != now["_dir"], F.lit(1)), "_push": F.when(p["push"] == 1, F.lit(1))}
        for block, field, edges in (("PSIZE_HIST", "size", S.SIZE_EDGES), ("IPT_HIST", "ipt", S.IPT_EDGES)):
            unit = F.call_function("shiftleft", F.lit(1).cast("bigint"), P.edge_bin(p[field], edges) * F.lit(5))
            add |= {f"_h_{block}{d.upper()}": F.when(c, unit) for d, c in one_way.items()}
        after = [(now[n] + F.coalesce(add[n].cast("bigint"), zero)).alias(n) for n in sums]
        return F.concat(states, F.array(F.struct(*after, p["dir"].cast("int").alias("_dir"))))

    return F.aggregate(ppi, F.array(start), step)


def prefix_grid(
    flows: DataFrame, ks: Sequence[int] = tuple(S.K_GRID), keep: Sequence[str] = ("flow_id",)
) -> DataFrame:
    """Prefix statistics of every K of a grid, one row per (flow, k). Nothing is shuffled, and
    the packets of a flow are passed once for all K."""
    grid = check_grid(ks)
    running = flows.where(F.size("ppi") > 0).select(*keep, _running_stats(F.slice("ppi", 1, grid[-1])).alias("_all"))
    length = F.size("_all") - 1
    at = [F.struct(F.lit(k).alias("k"), F.least(F.lit(k), length).alias("_len"), F.element_at("_all", F.least(F.lit(k), length) + 1).alias("s")) for k in grid]
    rows = running.select(*keep, F.explode(F.array(*at)).alias("_at")).select(*keep, "_at.k", "_at._len", "_at.s.*")
    counts = ("bytes", "bytes_rev", "packets", "packets_rev", "ppi_duration", "_len")
    return _prefix_columns(
        rows.select(
            *keep, "k",
            *[F.col(c).cast("double").alias(c) for c in counts],
            F.floor(F.col("_turns") / 2).cast("double").alias("ppi_roundtrips"),
            (F.col("_push") > 0).cast("double").alias("_push"),
            *[f"_h_{b}" for b in S.HIST_BLOCKS],
        ),
        [*keep, "k"],
    )


# --- standardisation ----------------------------------------------------------------

LOG_STATS = [c.lower() for c in S.BASE_STATS]
STATS = [c.lower() for c in S.FLOWSTATS]


def scaled_stats(stats: DataFrame, keep: Sequence[str] = ("flow_id",)) -> DataFrame:
    """log1p of the counts, every 8-bin histogram as proportions, flags as they are."""
    exprs = [F.log1p(F.greatest(F.col(c), F.lit(0.0))).alias(c) for c in LOG_STATS]
    for block in (b.lower() for b in S.HIST_BLOCKS):
        cols = [f"{block}_{i}" for i in range(S.N_BINS)]
        whole = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
        exprs += [
            F.when(whole > 0, F.col(c) / whole).otherwise(F.lit(0.0)).alias(c) for c in cols
        ]
    exprs += [F.col(f"flag_{n.lower()}") for n in S.FLAG_BITS]
    return stats.select(*keep, *exprs)


def _moments(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, mean, std) with population deviation; a constant column gets std 1."""
    wide = rows.agg(
        *[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"m_{c}").alias("mean"),
                F.when(F.col(f"s_{c}") < 1e-8, F.lit(1.0)).otherwise(F.col(f"s_{c}")).alias("std"),
            )
            for c in cols
        ]
    )
    return wide.select(F.explode(entries).alias("e")).select("e.*")


def fit_continuous(flows: DataFrame) -> DataFrame:
    """Mean and deviation of the four channels over real packets."""
    packets = flows.select(F.explode(P.continuous(F.col("ppi"))).alias("p")).select("p.*")
    return _moments(packets, S.CHANNELS)


def fit_flowstats(stats: DataFrame) -> DataFrame:
    return _moments(scaled_stats(stats, []), STATS)


def fit_standardizer(flows: DataFrame, stats: DataFrame) -> DataFrame:
    """Both fits as one small table (view, column, mean, std). Give it training flows only."""
    cont = fit_continuous(flows).withColumn("view", F.lit("continuous"))
    return cont.unionByName(fit_flowstats(stats).withColumn("view", F.lit("flowstats")))


def fit_many(parts: Sequence[DataFrame], stats: Sequence[DataFrame]) -> DataFrame:
    """A fit over several periods is the fit over their union."""
    if not parts:
        raise ValueError("no periods given")
    flows, table = parts[0], stats[0]
    for f, s in zip(parts[1:], stats[1:], strict=True):
        flows, table = flows.unionByName(f), table.unionByName(s)
    return fit_standardizer(flows, table)


def standardizer_hash(fit: DataFrame) -> DataFrame:
    """Order-free hash of a fit; equal fits have equal hashes."""
    rounded = fit.select(
        F.concat_ws(
            "|", "view", "column",
            F.format_number("mean", 9), F.format_number("std", 9),
        ).alias("line")
    )
    return rounded.agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("hash")
    )


def _as_row(fit: DataFrame, view: str, cols: Sequence[str]) -> DataFrame:
    """The fit of one view as a single broadcastable row of two maps (50 entries at most)."""
    return fit.where(F.col("view") == view).agg(
        F.map_from_entries(F.collect_list(F.struct("column", "mean"))).alias("_mean"),
        F.map_from_entries(F.collect_list(F.struct("column", "std"))).alias("_std"),
    )


def transform_flowstats(stats: DataFrame, fit: DataFrame, keep: Sequence[str] = ("flow_id",)) -> DataFrame:
    one = _as_row(fit, "flowstats", STATS)
    return (
        scaled_stats(stats, keep)
        .crossJoin(F.broadcast(one))
        .select(*keep, *[((F.col(c) - F.col("_mean")[c]) / F.col("_std")[c]).alias(c) for c in STATS])
    )


def transform_continuous(flows: DataFrame, fit: DataFrame, keep: Sequence[str] = ("flow_id",)) -> DataFrame:
    """Standardised channels, 30 wide; padded positions are zero, not the scaled zero."""
    one = _as_row(fit, "continuous", S.CHANNELS)
    scaled = F.transform(
        P.continuous(F.col("ppi")),
        lambda p: F.struct(
            *[((p[c] - F.col("_mean")[c]) / F.col("_std")[c]).alias(c) for c in S.CHANNELS]
        ),
    )
    pad = F.struct(*[F.lit(0.0).alias(c) for c in S.CHANNELS])
    return (
        flows.crossJoin(F.broadcast(one))
        .select(
            *keep,
            F.concat(
                scaled, F.array_repeat(pad, F.lit(S.K_MAX) - F.least(F.size("ppi"), F.lit(S.K_MAX)))
            ).alias("cont"),
        )
    )


# --- views ---------------------------------------------------------------------------


def cut_prefix(flows: DataFrame, k: int, cap_length: bool = False) -> DataFrame:
    """First ``k`` packets. The true length is kept unless ``cap_length``."""
    out = flows.withColumn("ppi", P.prefix(F.col("ppi"), k))
    if cap_length:
        out = out.withColumn("ppi_len", F.least("ppi_len", F.lit(k)))
    return out


def fingerprints(flows: DataFrame) -> DataFrame:
    """``fingerprint``: 64-bit hash of the token sequence."""
    toks = P.tokens(F.col("ppi"))
    return flows.withColumn("fingerprint", F.xxhash64(toks)).withColumn("token_key", toks)


def twins(flows: DataFrame, keep: Sequence[str] = ("label",)) -> DataFrame:
    """Groups of flows with equal token sequences: size and how many classes share them.

    Grouping is by the tokens themselves (a hash collision cannot merge two sequences), counted
    per label first so a sequence shared by a third of all flows is summed before the shuffle.
    """
    per_label = fingerprints(flows).groupBy("fingerprint", "token_key", *keep).agg(
        F.count("*").alias("n")
    )
    return per_label.groupBy("fingerprint", "token_key").agg(
        F.sum("n").alias("n"), F.max("n").alias("n_major"), F.count("*").alias("n_labels")
    )


def duplicate_report(flows: DataFrame) -> DataFrame:
    """Corpus duplicate rate and the accuracy ceiling set by conflicting labels."""
    return twins(flows).agg(
        F.sum("n").alias("n_flows"),
        F.count("*").alias("n_sequences"),
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(F.lit(0))).alias("n_with_twin"),
        (F.lit(1.0) - F.count("*") / F.sum("n")).alias("duplicate_rate"),
        (F.sum("n_major") / F.sum("n")).alias("label_ceiling"),
    )


def training_frame(
    flows: DataFrame, fit: DataFrame, views: Sequence[str] = ("continuous", "tokens"), train: bool = False
) -> DataFrame:
    """What a model reads: the asked views, mask, length and label.

    In train mode a flow of unknown label raises when it is read.
    """
    bad = set(views) - {"continuous", "tokens"}
    if bad or not views:
        raise ValueError(f"unknown views {sorted(bad)}")
    label = F.col("label")
    if train:
        label = F.when(
            label < 0, F.raise_error(F.lit("an unknown label reached a training set")).cast("int")
        ).otherwise(label)
    out = flows.select(
        "flow_id",
        label.alias("y"),
        "ppi_len",
        P.padding_mask(F.col("ppi_len")).alias("mask"),
        *([P.pad_tokens(F.col("ppi")).alias("tokens")] if "tokens" in views else []),
        "ppi",
    )
    if "continuous" in views:
        out = transform_continuous(out, fit, [c for c in out.columns if c != "ppi"])
        return out
    return out.drop("ppi")
