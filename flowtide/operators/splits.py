"""Splits, leakage rules, sampling and label spaces.

Checks raise ``LeakageError`` from the result of one small aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowtide import schema as S
from flowtide.functions.draws import Draw, uniform


class LeakageError(ValueError):
    pass


SPLIT_SCHEMA = "split string, ord int, period string, session_id int"


def split_table(spark: SparkSession, spec: Mapping[str, Mapping]) -> DataFrame:
    """{split: {periods, session_ids?}} in declared order as a table."""
    rows = []
    for i, (name, cfg) in enumerate(spec.items()):
        ids = cfg.get("session_ids")
        for p in cfg["periods"]:
            rows += [(name, i, p, s) for s in (ids if ids is not None else [None])]
    return spark.createDataFrame(rows, SPLIT_SCHEMA)


def assign(flows: DataFrame, splits: DataFrame) -> DataFrame:
    """Flows with their split; flows of no split drop out. The split table is a handful of rows."""
    s = splits.select(
        "split", "ord", F.col("period").alias("_p"), F.col("session_id").alias("_s")
    )
    match = (F.col("period") == F.col("_p")) & (F.col("_s").isNull() | (F.col("session_id") == F.col("_s")))
    return flows.join(F.broadcast(s), match).drop("_p", "_s")


def restrict_sessions(flows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Flows of the listed (period, session_id) pairs."""
    return flows.join(sessions.select("period", "session_id"), ["period", "session_id"], "left_semi")


def overlap_problems(splits: DataFrame) -> DataFrame:
    """Rule 1: periods claimed whole by more than one split, sessions claimed twice."""
    whole = splits.groupBy("period").agg(
        F.count_distinct("split").alias("n_splits"), F.max(F.col("session_id").isNull()).alias("has_whole")
    ).where("n_splits > 1 and has_whole").select("period", F.lit(None).cast("int").alias("session_id"), F.lit("period").alias("problem"))
    pairs = splits.where("session_id is not null").groupBy("period", "session_id").agg(
        F.count_distinct("split").alias("n_splits")
    ).where("n_splits > 1").select("period", "session_id", F.lit("session").alias("problem"))
    return whole.unionByName(pairs)


def assert_no_overlap(splits: DataFrame) -> None:
    bad = overlap_problems(splits).limit(5).collect()
    if bad:
        raise LeakageError(f"claimed by two splits: {[(r['period'], r['session_id']) for r in bad]}")


def assert_one_standardizer(hashes: DataFrame) -> None:
    """Rule 3: all splits name one standardizer hash (NULL = none named)."""
    n = hashes.agg(F.count_distinct("standardizer_hash")).first()[0]
    if n > 1:
        raise LeakageError(f"splits name {n} different standardizers")


def drop_held_out(flows: DataFrame, held_out: DataFrame) -> DataFrame:
    """Held-out classes leave the training split only. ``held_out`` has ``label``."""
    h = held_out.select("label").distinct().withColumn("split", F.lit("train"))
    return flows.join(F.broadcast(h), ["label", "split"], "left_anti")


def held_out_counts(flows: DataFrame, held_out: DataFrame) -> DataFrame:
    h = F.broadcast(held_out.select("label").distinct().withColumn("_h", F.lit(1)))
    return flows.join(h, "label", "left").groupBy("split").agg(
        F.count("*").alias("n"), F.count(F.when((F.col("_h") == 1) & (F.col("split") == "train"), 1)).alias("dropped")
    )


def training_label_problems(flows: DataFrame, held_out: DataFrame) -> DataFrame:
    """Rule 2: training rows of an unknown or held-out class, per label."""
    h = F.broadcast(held_out.select("label").distinct().withColumn("_h", F.lit(1)))
    return (
        flows.where("split = 'train'").join(h, "label", "left")
        .where((F.col("label") < 0) | (F.col("_h") == 1))
        .groupBy("label").agg(F.count("*").alias("n"))
    )


def assert_training_labels(flows: DataFrame, held_out: DataFrame) -> None:
    bad = training_label_problems(flows, held_out).collect()
    if bad:
        raise LeakageError(f"training rows of excluded classes: {sorted((r['label'], r['n']) for r in bad)}")


def boundary_floors(flows: DataFrame) -> DataFrame:
    """(split, ord, floor_ts): the latest time of the splits declared before.

    A split keeps only rows above its floor, and floors never fall, so the latest *kept* time of the
    splits before is the latest of all of them. One row per split.
    """
    per = flows.groupBy("split", "ord").agg(F.max("ts").alias("_max"))
    before = W.orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    return per.select("split", "ord", F.coalesce(F.max("_max").over(before), F.lit(-1)).alias("floor_ts"))


def trim_boundaries(flows: DataFrame) -> DataFrame:
    """Drop rows at or before the latest time of the splits before theirs."""
    floors = boundary_floors(flows).select("split", "floor_ts")
    return flows.join(F.broadcast(floors), "split").where(F.col("ts") > F.col("floor_ts")).drop("floor_ts")


def trim_counts(flows: DataFrame) -> DataFrame:
    floors = boundary_floors(flows).select("split", "floor_ts")
    gone = F.col("ts") <= F.col("floor_ts")
    return flows.join(F.broadcast(floors), "split").groupBy("split").agg(
        F.count("*").alias("n"), F.count(F.when(gone, 1)).alias("dropped")
    )


def assert_small_trim(flows: DataFrame, max_fraction: float = 0.001) -> None:
    for r in trim_counts(flows).collect():
        if r["dropped"] > max_fraction * r["n"]:
            raise LeakageError(f"split {r['split']}: {r['dropped']} of {r['n']} rows at or before the split before it")


def time_ranges(flows: DataFrame) -> DataFrame:
    return flows.groupBy("split").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def assert_temporal_order(flows: DataFrame, train: str = "train") -> None:
    """Rule 4: training ends before every other split starts."""
    got = {r["split"]: r for r in time_ranges(flows).collect()}
    if train not in got:
        return
    late = [s for s, r in got.items() if s != train and r["first_ts"] <= got[train]["last_ts"]]
    if late:
        raise LeakageError(f"splits {late} start before training ends")


# --- classes --------------------------------------------------------------------------------------


def class_profile(flows: DataFrame) -> DataFrame:
    """(label, support, category): category = most common, lowest id on a tie."""
    pairs = flows.groupBy("label", "category").agg(F.count("*").alias("n"))
    return pairs.groupBy("label").agg(
        F.sum("n").alias("support"), F.max_by("category", F.struct("n", -F.col("category"))).alias("category")
    )


def draw_open_set(profile: DataFrame, n_known: int, n_unknown: int, min_support: int, draw: Draw) -> DataFrame:
    """(label, role): unknown classes spread over categories, half from the rarer and half from the
    more frequent classes of each; short categories are topped up at random; then known classes.

    Works on the class table. The order inside a half is drawn from the label.
    """
    order = draw("open-set", F.col("label"))
    base = profile.select("label", "support", "category", order.alias("_o")).withColumn(
        "_ok", F.col("support") >= min_support
    )
    n = base.agg(F.count("*").alias("n"), F.count(F.when(F.col("_ok"), 1)).alias("ok"), F.count_distinct("category").alias("c")).first()
    if n["n"] < n_known + n_unknown:
        raise ValueError(f"need {n_known + n_unknown} classes, have {n['n']}")
    if n["ok"] < n_unknown:
        raise ValueError(f"only {n['ok']} classes have {min_support} flows; need {n_unknown}")
    each, extra = divmod(n_unknown, n["c"])
    quota = F.lit(each) + F.when(F.dense_rank().over(W.orderBy("category")) <= extra, F.lit(1)).otherwise(F.lit(0))
    cat = W.partitionBy("category")
    elig = base.withColumn("_quota", quota).where("_ok")
    elig = elig.withColumn("_n", F.count("*").over(cat)).withColumn(
        "_r", F.row_number().over(cat.orderBy("support", "label"))
    )
    half = F.floor(F.col("_n") / 2)
    elig = elig.withColumn("_rare", F.col("_r") <= half).withColumn("_half", half)
    take_rare = F.least(F.floor((F.col("_quota") + 1) / 2), F.col("_half"))
    elig = elig.withColumn("_take", F.when(F.col("_rare"), take_rare).otherwise(F.col("_quota") - take_rare))
    elig = elig.withColumn("_i", F.row_number().over(W.partitionBy("category", "_rare").orderBy("_o", "label")))
    first = F.col("_i") <= F.col("_take")
    # first choices, then everything else eligible: the top-up fills what short categories left
    ranked = elig.withColumn("_first", first).withColumn(
        "_u", F.row_number().over(W.orderBy(F.col("_first").desc(), "_o", "label"))
    )
    unknown = ranked.where(F.col("_u") <= n_unknown).select("label", F.lit("unknown").alias("role"))
    rest = base.join(unknown.select("label"), "label", "left_anti").withColumn(
        "_k", F.row_number().over(W.orderBy(draw("open-set/known", F.col("label")), "label"))
    )
    return unknown.unionByName(rest.where(F.col("_k") <= n_known).select("label", F.lit("known").alias("role")))


def label_space(spark: SparkSession, known: Sequence[int], unknown: Sequence[int] = (), names: Mapping[int, str] | None = None) -> DataFrame:
    """(dataset_id, model_idx, name): dense index of the known ids, -1 for held-out ids and -1."""
    k, u = sorted(set(known)), sorted(set(unknown))
    if not k:
        raise ValueError("a label space needs at least one known class")
    if min([*k, *u]) < 0:
        raise ValueError("class ids must not be negative")
    if set(k) & set(u):
        raise ValueError(f"classes cannot be both known and unknown: {sorted(set(k) & set(u))}")
    stray = set(names or {}) - set(k) - set(u)
    if stray:
        raise ValueError(f"names for ids outside the label space: {sorted(stray)}")
    name = lambda c: (names or {}).get(c, str(c))
    rows = [(c, i, name(c)) for i, c in enumerate(k)] + [(c, -1, name(c)) for c in u] + [(-1, -1, "unknown")]
    return spark.createDataFrame(rows, "dataset_id int, model_idx int, name string")


def to_model(flows: DataFrame, space: DataFrame, label: str = "label") -> DataFrame:
    """Dataset ids to model indices; an id the space does not have raises when read."""
    s = F.broadcast(space.select(F.col("dataset_id").alias("_d"), F.col("model_idx").alias("_m")))
    idx = F.when(
        F.col("_m").isNull(),
        F.raise_error(F.concat(F.lit("label not in the label space: "), F.col(label).cast("string"))).cast("int"),
    ).otherwise(F.col("_m"))
    return flows.join(s, F.col(label) == F.col("_d"), "left").withColumn("model_idx", idx).drop("_d", "_m")


def to_dataset(rows: DataFrame, space: DataFrame, idx: str = "model_idx") -> DataFrame:
    s = F.broadcast(space.where("model_idx >= 0").select(F.col("dataset_id").alias("_d"), F.col("model_idx").alias("_m")))
    return rows.join(s, F.col(idx) == F.col("_m"), "left").withColumn(
        "dataset_id", F.coalesce("_d", F.lit(S.UNKNOWN))
    ).drop("_d", "_m")


def class_counts(flows: DataFrame, space: DataFrame, label: str = "label") -> DataFrame:
    """Counts of every known class, zero included."""
    n = flows.groupBy(F.col(label).alias("dataset_id")).agg(F.count("*").alias("n"))
    return space.where("model_idx >= 0").join(n, "dataset_id", "left").select(
        "dataset_id", "model_idx", F.coalesce("n", F.lit(0)).alias("n")
    )


def balanced_weights(flows: DataFrame, cap: float = 10.0, label: str = "label") -> DataFrame:
    """Adds ``weight``: min(cap, mean / n_c) per row, normalised to sum 1.

    Class sizes are one small aggregate, so no class is gathered in a window.
    """
    if cap < 1:
        raise ValueError(f"cap must be at least 1, got {cap}")
    sizes = flows.groupBy(F.col(label).alias("_c")).agg(F.count("*").alias("_n"))
    factor = F.least(F.lit(float(cap)), F.avg("_n").over(W.partitionBy()) / F.col("_n"))
    f = sizes.select("_c", "_n", factor.alias("_f"))
    f = f.select("_c", (F.col("_f") / F.sum(F.col("_f") * F.col("_n")).over(W.partitionBy())).alias("weight"))
    return flows.join(F.broadcast(f), F.col(label) == F.col("_c")).drop("_c")


# --- sampling -------------------------------------------------------------------------------------


def sample_rows(rows: DataFrame, rate: float, seed: int, *keys: Column) -> DataFrame:
    """Keep each row with probability ``rate``; depends on the row's key only."""
    return rows.where(uniform(seed, "row-sample", *keys) < F.lit(float(rate)))


def subsample(rows: DataFrame, n: int, draw: Draw, key: str, order: Sequence[str] | None = None) -> DataFrame:
    """``n`` rows without replacement, in their original order (``order``, default the key).

    Rows are numbered in the order of their draws, in ranges, so no sample passes through one task.
    """
    from flowtide.operators.ordered import global_row_number

    placed = global_row_number(rows.withColumn("_d", draw("subsample", F.col(key))), ["_d", key], "_rn")
    return placed.where(F.col("_rn") <= n).drop("_d", "_rn", "_rn_total").orderBy(*(order or [key]))


def label_fraction(rows: DataFrame, fraction: float, draw: Draw, key: str) -> DataFrame:
    """max(1, round(fraction n)) rows."""
    total = rows.count()
    return subsample(rows, max(1, round(fraction * total)), draw, key)


def at_most_per_group(rows: DataFrame, group: str, n: int, draw: Draw, key: str) -> DataFrame:
    """At most ``n`` rows per group in hash order.

    A row number below a limit is cut in each task first, so a huge group sends n rows per task.
    """
    w = W.partitionBy(group).orderBy(draw("per-group", F.col(key)), key)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def epoch_permutations(rows: DataFrame, n_samples: int, draw: Draw, key: str) -> DataFrame:
    """(pass_no, slot, key): fresh permutations, each row once per pass, cut to ``n_samples``."""
    from flowtide.operators.ordered import global_row_number

    if n_samples < 1:
        raise ValueError(f"n_samples must be at least 1, got {n_samples}")
    n = rows.count()
    passes = -(-n_samples // n)
    wide = rows.select(key, F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass_no"))
    placed = global_row_number(wide.withColumn("_d", draw("epoch", F.col(key), F.col("pass_no"))), ["pass_no", "_d", key], "slot")
    return placed.where(F.col("slot") <= n_samples).select("pass_no", "slot", key)


def replay_sample(flows: DataFrame, period: str, n: int, draw: Draw, space: DataFrame) -> DataFrame:
    """``n`` flows of one period with class name and whether the class is known."""

    picked = subsample(flows.where(F.col("period") == period), n, draw, "flow_id")
    s = F.broadcast(space.select(F.col("dataset_id").alias("_d"), "name", (F.col("model_idx") >= 0).alias("known")))
    return picked.join(s, F.col("label") == F.col("_d"), "left").drop("_d")
