"""Global order without a single-task window: running totals, row numbers, exact quantiles.

Rows are range-partitioned on (groups, order), so a group holding a third of all rows is spread
over many partitions. Each partition sums its own part, a table with one row per (partition,
group) turns those sums into offsets, and the windows stay inside a partition. The partition
number has to be the same in both uses, so the partitioned rows are materialised once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowtide.session import cut


def _range_order(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def running_totals(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str | Column],
    sums: dict[str, Column | str],
) -> DataFrame:
    """Add, per name in ``sums``, the running total over ``groups`` in ``order`` (``name``) and
    the group's grand total (``name_total``). ``order`` must be unique inside a group."""
    groups = list(groups)
    keyed = df.select(
        "*", *[(F.col(e) if isinstance(e, str) else e).alias(f"__v_{n}") for n, e in sums.items()]
    )
    spread = keyed.repartitionByRange(*[F.col(g) for g in groups], *_range_order(order))
    spread = cut(spread.withColumn("__part", F.spark_partition_id()))

    per_part = spread.groupBy(*groups, "__part").agg(
        *[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in sums]
    )
    before = W.partitionBy(*groups).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*groups)
    offsets = per_part.select(
        *[F.col(g).alias(f"__g_{g}") for g in groups],
        F.col("__part").alias("__at"),
        *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums],
        *[F.sum(f"__s_{n}").over(whole).alias(f"{n}_total") for n in sums],
    )
    match = F.col("__part") == F.col("__at")
    for g in groups:
        match = match & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    inside = (
        W.partitionBy("__part", *groups)
        .orderBy(*_range_order(order))
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    out = spread.join(offsets, match)
    for n in sums:
        out = out.withColumn(n, F.sum(f"__v_{n}").over(inside) + F.col(f"__o_{n}"))
    helper = [c for c in out.columns if c.startswith("__v_") or c.startswith("__o_")]
    return out.drop("__part", "__at", *helper, *[f"__g_{g}" for g in groups])


def global_row_number(
    df: DataFrame, order: Sequence[str | Column], name: str = "rn", groups: Sequence[str] = ()
) -> DataFrame:
    """1-based position of every row in ``order`` (per group), plus ``{name}_total``."""
    return running_totals(df, groups, order, {name: F.lit(1).cast("bigint")})


def average_ranks(df: DataFrame, groups: Sequence[str], value: str, name: str) -> DataFrame:
    """Add the 1-based rank of ``value`` inside ``groups`` as ``name``; equal values share the mean of their ranks.

    Rows are ordered once, and equal values may lie in several partitions: a value that crosses a border is the
    first or last of each partition it is in, so a table with one row per (partition, group) closes its ties.
    No row is joined on its value, however often that occurs.
    """
    groups = list(groups)
    # the position of the row spreads a frequent value over partitions
    keyed = df.withColumn("__tie", F.monotonically_increasing_id())
    spread = keyed.repartitionByRange(*[F.col(g) for g in groups], F.col(value), F.col("__tie"))
    spread = cut(spread.drop("__tie").withColumn("__part", F.spark_partition_id()))

    counted = spread.groupBy(*groups, "__part", F.col(value).alias("__x")).agg(F.count("*").alias("__n"))
    end = F.struct("__x", "__n")
    per_part = cut(counted.groupBy(*groups, "__part").agg(F.sum("__n").alias("__rows"), F.min(end).alias("__lo"), F.max(end).alias("__hi")))
    ends = per_part.select(*groups, "__part", F.explode(F.array_distinct(F.array("__lo", "__hi"))).alias("e")).select(*groups, "__part", "e.*")
    parts = W.partitionBy(*groups).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    ties = W.partitionBy(*groups, "__x")
    before = ties.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(
        *groups, "__part", F.struct("__x", F.sum("__n").over(ties).alias("n"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("before")).alias("e")
    )
    borders = ends.groupBy(*groups, "__part").agg(F.min("e").alias("__first"), F.max("e").alias("__last"))
    offsets = per_part.select(*groups, "__part", F.coalesce(F.sum("__rows").over(parts), F.lit(0)).alias("__offset"))

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        named = right.toDF(*[f"__g_{c}" if c in [*groups, "__part"] else c for c in right.columns])
        same = F.lit(True)
        for c in [*groups, "__part"]:
            same = same & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
        return left.join(named, same).drop(*[f"__g_{c}" for c in [*groups, "__part"]])

    inside = W.partitionBy("__part", *groups).orderBy(value)
    placed = beside(spread, beside(offsets, borders)).select(
        "*", (F.rank().over(inside) - 1).alias("__smaller"), F.count("*").over(inside.rangeBetween(W.currentRow, W.currentRow)).alias("__same")
    )
    first, last = F.col(value) == F.col("__first.__x"), F.col(value) == F.col("__last.__x")
    smaller = F.col("__offset") + F.col("__smaller") - F.when(first, F.col("__first.before")).otherwise(F.lit(0))
    same = F.when(first, F.col("__first.n")).when(last, F.col("__last.n")).otherwise(F.col("__same"))
    return placed.select(*df.columns, (smaller + (same + 1) / F.lit(2.0)).alias(name))


def exact_quantiles(
    df: DataFrame, groups: Sequence[str], value: str, probs: Sequence[float]
) -> DataFrame:
    """Linear-interpolation quantiles per group, exact at any size.

    Returns one row per (group, prob) with columns ``prob`` and ``quantile``. Equal values are
    counted first, so the ordered pass only sees distinct values.
    """
    groups = list(groups)
    counted = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(
        F.count("*").alias("_c")
    )
    cum = running_totals(counted, groups, [value], {"_cum": "_c"})
    # the probabilities travel as one row; a value keeps the positions its rank span covers
    one = df.sparkSession.createDataFrame([([float(p) for p in probs],)], "_probs array<double>")
    spans = cum.select(
        *groups,
        F.col(value).cast("double").alias("_x"),
        (F.col("_cum") - F.col("_c")).alias("_from"),
        F.col("_cum").alias("_to"),
        (F.col("_cum_total") - 1).alias("_last"),
    ).crossJoin(F.broadcast(one))
    hit = spans.select(
        *groups,
        "_x",
        F.explode(
            F.expr(
                "transform(filter(_probs, p -> floor(p * _last) < _to and floor(p * _last) + 1 >= _from),"
                " p -> named_struct('prob', p, 'frac', p * _last - floor(p * _last),"
                " 'at_lo', floor(p * _last) >= _from and floor(p * _last) < _to,"
                " 'at_hi', least(floor(p * _last) + 1, _last) >= _from"
                " and least(floor(p * _last) + 1, _last) < _to))"
            )
        ).alias("s"),
    )
    return (
        hit.groupBy(*groups, F.col("s.prob").alias("prob"))
        .agg(
            F.max(F.when(F.col("s.at_lo"), F.col("_x"))).alias("_lo"),
            F.max(F.when(F.col("s.at_hi"), F.col("_x"))).alias("_hi"),
            F.max("s.frac").alias("_frac"),
        )
        .select(
            *groups,
            "prob",
            (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac")).alias("quantile"),
        )
    )
