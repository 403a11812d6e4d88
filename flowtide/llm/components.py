"""Connected components of a table of links, by contraction in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.session import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node in ``links`` (columns ``a`` and ``b``, long, no nulls).

    In a round every node points at the first of itself and its neighbours in an order drawn by hash,
    pointers are doubled, and the links are drawn anew between the nodes pointed at, until none is left.
    As the order is drawn anew each round, a round removes a fixed share of the nodes whatever the
    shape, and a chain does not take as many rounds as it has nodes. Rounds are written to the shared
    folder; only whether links are left reaches the driver.
    """
    left = cut(links.where("a <> b").select("a", "b").distinct())
    found = None
    turn = 0
    while not left.isEmpty():
        turn += 1
        place = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("at"))  # noqa: B023, E731
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min(place("b")).alias("n"))
        pointer = nearest.select(F.col("a").alias("node"), F.least(place("a"), "n")["at"].alias("root"))
        jump = pointer.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        pointer = cut(pointer.join(jump, "root").select("node", F.col("_next").alias("root")))
        if found is None:
            found = pointer
        else:
            step = pointer.select(F.col("node").alias("root"), F.col("root").alias("_next"))
            found = cut(found.join(step, "root", "left").select("node", F.coalesce("_next", "root").alias("root")))
        a = pointer.select(F.col("node").alias("a"), F.col("root").alias("_a"))
        b = pointer.select(F.col("node").alias("b"), F.col("root").alias("_b"))
        left = cut(left.join(a, "a").join(b, "b").where("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct())
    return left.select(F.col("a").alias("node"), F.col("b").alias("root")) if found is None else found
