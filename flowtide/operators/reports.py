"""Paired comparison of models, and tables over runs."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowtide import schema as S
from flowtide.operators import metrics as M
from flowtide.operators import policies as H
from flowtide.operators import scores as C

# --- paired bootstrap -----------------------------------------------------------------------------


def predictions(scores: DataFrame, ks: Sequence[int]) -> DataFrame:
    """One row per flow: label, length and the predicted class at every K of a grid."""
    return scores.select(
        "flow_id", "label", "ppi_len", F.array(*[F.lit(k) for k in ks]).alias("ks"),
        F.transform(F.array(*[F.lit(k) for k in ks]), lambda k: F.element_at("pred", k)).alias("preds"),
    )


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Known flows with both models' correctness per K (0/1 arrays). Different flow sets raise."""
    sides = lambda d, s: d.select("flow_id", F.struct("label", "ppi_len", "ks").alias(f"m{s}"), F.col("preds").alias(f"p{s}"))
    both = sides(a, "a").join(sides(b, "b"), "flow_id", "full_outer")
    bad = ~F.col("ma").eqNullSafe(F.col("mb"))
    label = F.when(bad, F.raise_error(F.lit("the two prediction sets are not over the same flows")).cast("int")).otherwise(F.col("ma.label"))
    rows = both.select("flow_id", label.alias("label"), "pa", "pb").where("label >= 0")
    hit = lambda p: F.transform(p, lambda c: (c == F.col("label")).cast("int"))
    return rows.select(hit("pa").alias("ca"), hit("pb").alias("cb"))


def patterns(pairs: DataFrame) -> DataFrame:
    """Distinct (correct a, correct b) patterns with counts: all a resample needs to know."""
    return pairs.groupBy("ca", "cb").agg(F.count("*").alias("n"))


def observed(pat: DataFrame, ks: Sequence[int]) -> DataFrame:
    """(k, a, b, diff) accuracies; k = 0 is the mean over the grid."""
    cols = [(k, F.col("ca")[i], F.col("cb")[i]) for i, k in enumerate(ks)]
    total = F.sum("n")
    row = pat.agg(
        F.array(*[F.struct(F.lit(k).alias("k"), (F.sum(a * F.col("n")) / total).alias("a"), (F.sum(b * F.col("n")) / total).alias("b")) for k, a, b in cols]).alias("r")
    )
    per = row.select(F.explode("r").alias("e")).select("e.*")
    mean = per.agg(F.lit(0).alias("k"), F.avg("a").alias("a"), F.avg("b").alias("b"))
    return per.unionByName(mean).withColumn("diff", F.col("b") - F.col("a"))


def resamples(pat: DataFrame, ks: Sequence[int], n: int, seed: int) -> DataFrame:
    """(resample, k, diff): accuracy differences under ``n`` Poisson resamples of the flows.

    A pattern of c flows gets weight Poisson(c), seeded by (seed, pattern), so the draw does not
    depend on partitions. Every task sends one row per resample.
    """
    j = len(ks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((n, 2 * j + 1))
        for b in batches:
            for a, c, count, key in zip(b.column("ca"), b.column("cb"), b.column("n"), b.column("key"), strict=True):
                rng = np.random.default_rng([seed, key.as_py() & 0xFFFFFFFFFFFF])
                w = rng.poisson(count.as_py(), n)
                sums += w[:, None] * np.array([*a.as_py(), *c.as_py(), 1.0])[None]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(n, dtype=np.int32)), pa.array(list(sums))], names=["resample", "s"]
        )

    parts = pat.select("ca", "cb", "n", F.xxhash64("ca", "cb").alias("key")).mapInArrow(run, "resample int, s array<double>")
    total = parts.groupBy("resample").agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(2 * j + 1)])
    w = F.col(f"s{2 * j}")
    diffs = [(k, (F.col(f"s{j + i}") - F.col(f"s{i}")) / w) for i, k in enumerate(ks)]
    mean = sum((d for _, d in diffs[1:]), diffs[0][1]) / j
    return total.where(w > 0).select(
        "resample", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), d.alias("diff")) for k, d in [*diffs, (0, mean)]])).alias("e")
    ).select("resample", "e.*")


def paired_bootstrap(a: DataFrame, b: DataFrame, ks: Sequence[int], n: int = 1000, seed: int = 0) -> DataFrame:
    """Observed difference b - a per K (0 = mean over K), 95 % interval, share of resamples not better."""
    pat = patterns(paired(a, b))
    # n values per K
    spread = resamples(pat, ks, n, seed).groupBy("k").agg(
        F.percentile("diff", F.lit(0.025)).alias("ci_lo"), F.percentile("diff", F.lit(0.975)).alias("ci_hi"),
        F.avg((F.col("diff") <= 0).cast("double")).alias("p_not_better"),
    )
    return observed(pat, ks).join(spread, "k")


def seed_interval(values: DataFrame, by: Sequence[str], value: str, n: int = 1000, seed: int = 0) -> DataFrame:
    """95 % interval of the mean over seeds by resampling the (few) seed values of a group."""

    def run(part: pa.Table) -> pa.Table:
        x = np.sort(part.column(value).to_numpy())
        means = np.random.default_rng(seed).choice(x, (n, len(x))).mean(1)
        lo, hi = np.percentile(means, [2.5, 97.5])
        cols = {c: [part.column(c)[0].as_py()] for c in by}
        return pa.table({**cols, "mean": [float(x.mean())], "ci_lo": [float(lo)], "ci_hi": [float(hi)], "n": [len(x)]})

    schema = ", ".join(f"{c} {values.schema[c].dataType.simpleString()}" for c in by)
    return values.groupBy(*by).applyInArrow(run, f"{schema}, mean double, ci_lo double, ci_hi double, n bigint")


# --- runs -----------------------------------------------------------------------------------------


def finished_runs(runs: DataFrame, allow_dirty: bool = False) -> DataFrame:
    """Finished runs with stage, group and seed read off their names. Names of another form drop out.

    A dirty tree raises unless allowed.
    """
    from flowtide.functions.labels import run_name_part

    name = F.col("run_name")
    rows = runs.where("status = 'FINISHED'").select(
        "*", run_name_part(name, "stage").alias("stage"), run_name_part(name, "group").alias("run_group"), run_name_part(name, "seed").alias("run_seed")
    ).where("stage <> ''")
    if not allow_dirty:
        rows = rows.withColumn(
            "run_group",
            F.when(F.col("git_dirty"), F.raise_error(F.concat(F.lit("run from a dirty tree: "), name))).otherwise(F.col("run_group")),
        )
    return rows


def hash_conflicts(rows: DataFrame) -> DataFrame:
    """Groups that mix config hashes."""
    return rows.groupBy("run_group").agg(
        F.count_distinct("config_hash").alias("n_hashes"), F.array_sort(F.collect_set("config_hash")).alias("hashes")
    ).where("n_hashes > 1")


def assert_one_config(rows: DataFrame) -> None:
    bad = hash_conflicts(rows).limit(1).collect()
    if bad:
        raise ValueError(f"group {bad[0]['run_group']} mixes config hashes {bad[0]['hashes']}")


def group_table(rows: DataFrame, by: Sequence[str] = ("run_group", "metric")) -> DataFrame:
    """Mean, sample deviation, number of seeds, commits and hashes per group and metric."""
    return rows.groupBy(*by).agg(
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.count("*").alias("n"),
        F.array_sort(F.collect_set("run_seed")).alias("seeds"), F.array_sort(F.collect_set("git_commit")).alias("commits"),
        F.array_sort(F.collect_set("config_hash")).alias("hashes"),
    )


def condition_deltas(rows: DataFrame, by: Sequence[str], condition: str = "condition", value: str = "value") -> DataFrame:
    """Every condition's value and its change from ``clean``. Missing clean rows raise."""
    by = list(by)
    clean = rows.where(F.col(condition) == "clean").select(*by, F.col(value).alias("_clean"))
    joined = rows.join(clean, by, "left")
    delta = F.when(
        F.col("_clean").isNull(), F.raise_error(F.lit("no clean row to compare with")).cast("double")
    ).otherwise(F.col(value) - F.col("_clean"))
    return joined.select(*by, condition, value, delta.alias("delta"))


def assert_same_conditions(rows: DataFrame, names: Sequence[str], by: Sequence[str] = (), condition: str = "condition") -> None:
    got = rows.groupBy(*by).agg(F.array_sort(F.collect_set(condition)).alias("c")).select("c").distinct().collect()
    if [r["c"] for r in got] != [sorted(names)]:
        raise ValueError(f"conditions {[r['c'] for r in got]} do not match {sorted(names)}")


def acceptance(measured: DataFrame, criteria: DataFrame) -> DataFrame:
    """(name, value, bar, verdict): met, not met, or reported where there is no bar or no value.

    ``criteria``: name, op (``>=`` or ``<=``), bar (NULL = report only).
    """
    both = F.broadcast(criteria).join(measured, "name", "left")
    ok = F.when(F.col("op") == ">=", F.col("value") >= F.col("bar")).otherwise(F.col("value") <= F.col("bar"))
    verdict = F.when(F.col("value").isNull(), F.lit("not measured")).when(F.col("bar").isNull(), F.lit("reported")).when(ok, F.lit("met")).otherwise(F.lit("not met"))
    return both.select("name", "value", "bar", verdict.alias("verdict"))


def read_reports(spark, paths: str | Sequence[str], fields: Mapping[str, str]) -> DataFrame:
    """JSON reports, one per seed: (seed from the file name, one column per JSON path)."""
    raw = spark.read.text(paths, wholetext=True)
    seed = F.regexp_extract(F.col("_metadata.file_path"), r"seed-?(\d+)", 1).cast("int")
    return raw.select(seed.alias("seed"), *[F.get_json_object("value", p).cast("double").alias(n) for n, p in fields.items()])


def thin(points: DataFrame, order: str, by: Sequence[str] = (), n: int = 45) -> DataFrame:
    """At most ``n`` evenly spaced points of each front, its ends included. A front has a few hundred."""
    w = W.partitionBy(*by)
    rows = points.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    slot = F.floor(F.col("_i") * (n - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    before = F.floor((F.col("_i") - 1) * (n - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    return rows.where((F.col("_i") == 0) | (slot > before)).drop("_i", "_n")


# --- one report -----------------------------------------------------------------------------------


def evaluation_report(scores: DataFrame, ks: Sequence[int] = tuple(S.K_GRID)) -> DataFrame:
    """One long metric table (metric, k, value) of a split: accuracy curve, AUC over K, k95, macro-F1,
    balanced accuracy, calibration error and unknown AUROC per K where unknown flows exist."""
    known = C.long_scores(C.known_only(scores), ["pred", "conf"], ["flow_id", "label", "ppi_len"]).where(F.col("k").isin(list(ks)))
    curve = M.accuracy(known, ["k"])
    row = lambda df, name, value, k=None: df.select(
        F.lit(name).alias("metric"), (F.col("k") if k is None else F.lit(k)).cast("int").alias("k"), F.col(value).cast("double").alias("value")
    )
    last = known.where(F.col("k") == max(ks))
    macro = M.macro_scores(last)
    parts = [
        row(curve, "accuracy", "accuracy"),
        row(M.auc_k(curve), "auc_k", "auc_k", 0),
        row(M.k95(curve), "k95", "k95", 0),
        row(macro, "macro_f1", "macro_f1", max(ks)),
        row(macro, "balanced_accuracy", "balanced_accuracy", max(ks)),
        row(M.ece(known, "conf", M.is_correct(), ["k"]), "ece", "ece"),
    ]
    echo = M.policy_metrics(C.known_only(H.confidence_stop(scores, 0.5)))
    parts += [row(echo, f"confidence_stop_{c}", c, 0) for c in ("mean_k", "coverage", "committed_accuracy")]
    u = C.reached(C.long_scores(scores, ["energy_raw"], ["flow_id", "label", "ppi_len"])).where(F.col("k").isin(list(ks)))
    parts.append(row(M.auroc(u, "energy_raw", F.col("label") < 0, ["k"]).where("auroc is not null"), "unknown_auroc", "auroc"))
    return C.concat(parts)


def robustness(reports: DataFrame) -> DataFrame:
    """(condition, metric, k, value, delta) of per-condition reports against clean."""
    return condition_deltas(reports, ["metric", "k"])
