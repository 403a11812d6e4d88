"""What a model leaves behind for every flow and prefix, as 30-wide arrays on one row per flow.

A score row carries ``flow_id, label (-1 unknown), ppi_len, period`` and arrays indexed by K - 1.
Everything that reads a score row is a narrow projection; only aggregates shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtide import schema as S
from flowtide.functions import ppi as P


def rounded(values: np.ndarray, digits: int | None) -> np.ndarray:
    """Operators keep doubles as they come. The last bits depend on the order of additions, so a caller that
    compares runs of different engines asks for digits."""
    return values if digits is None else np.round(values, digits)


def rounded_column(c: Column, digits: int | None) -> Column:
    return c if digits is None else F.round(c, digits)


class Scorer(Protocol):
    """Anything that scores prefixes. Runs inside tasks, on Arrow batches and in streams."""

    version: str
    n_classes: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        """[n, 60+] prefix features (two per packet) to [n, 30, C] class logits."""


@dataclass(frozen=True)
class CentroidScorer:
    """Nearest class centre on the first 2K features: logit = -scale * squared distance."""

    centers: np.ndarray  # [C, 60]
    scale: float
    version: str = "centroid-1"
    digits: int | None = None

    @property
    def n_classes(self) -> int:
        return len(self.centers)

    def logits(self, x: np.ndarray) -> np.ndarray:
        d = 2 * S.K_MAX
        gap = x[:, None, :d] - self.centers[None]
        run = np.cumsum(gap * gap, axis=2)[:, :, 1::2]
        return rounded(-self.scale * run, self.digits).transpose(0, 2, 1)


def fit_centroids(train: DataFrame, n_classes: int, scale: float, x: str = "x", digits: int | None = None) -> CentroidScorer:
    """Class means of the first 60 features over known training rows; C x 60 numbers come back."""
    d = 2 * S.K_MAX
    rows = (
        train.where(F.col("label") >= 0)
        .select("label", F.posexplode(F.slice(x, 1, d)).alias("d", "v"))
        .groupBy("label", "d")
        .agg(rounded_column(F.avg("v"), digits).alias("m"))
        .collect()
    )
    centers = np.zeros((n_classes, d))
    for r in rows:
        centers[r["label"], r["d"]] = r["m"]
    return CentroidScorer(centers, scale, digits=digits)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return arr.flatten().to_numpy(zero_copy_only=False).reshape(len(arr), -1)


def _arrays(values: np.ndarray) -> pa.Array:
    """[n, m] numbers as list<double> rows."""
    n, m = values.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * m)
    return pa.ListArray.from_arrays(offsets, pa.array(values.reshape(-1)))


#: flows whose per-K copies are held at a time, and flows whose copies per K and class are
SLICE, NEAR = 512, 16


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``SLICE`` rows: what a task holds does not depend on how many rows it is handed at once."""
    for b in batches:
        for i in range(0, b.num_rows, SLICE):
            yield b.slice(i, SLICE)


def score_logits(flows: DataFrame, scorer: Scorer, x: str = "x") -> DataFrame:
    """Run a scorer over every flow; adds ``z``: 30 x C logits, flat, K major."""
    keep = [c for c in flows.columns if c != x]
    out = T.StructType([flows.schema[c] for c in keep] + [T.StructField("z", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            z = scorer.logits(_matrix(b.column(x)).astype(np.float64))
            cols = [b.column(c) for c in keep] + [_arrays(z.reshape(b.num_rows, -1))]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "z"])

    return flows.select(*keep, x).mapInArrow(run, out)


def logits_at(z: Column, k: Column, n_classes: int) -> Column:
    """The C logits of prefix ``k`` (1-based) out of the flat array."""
    return F.slice(z, (k - 1) * n_classes + 1, F.lit(n_classes))


def check_evaluated(ks: Sequence[int], evaluated: Sequence[int]) -> list[int]:
    """Every asked K must have been evaluated."""
    missing = sorted(set(ks) - set(evaluated))
    if missing:
        raise ValueError(f"K values {missing} were not evaluated")
    return sorted(ks)


def read_at(
    flows: DataFrame, ks: Sequence[int], n_classes: int, indexing: str = "effective",
    evaluated: Sequence[int] = tuple(range(1, S.K_MAX + 1)), keep: Sequence[str] = ("flow_id",),
) -> DataFrame:
    """Logits at nominal K, long form (…, k, c, z).

    ``effective``: a flow shorter than K is read at its own last packet. ``nominal``: at K.
    """
    if indexing not in ("effective", "nominal"):
        raise ValueError(f"indexing must be effective or nominal, got {indexing!r}")
    grid = check_evaluated(ks, evaluated)
    k = F.explode(F.array(*[F.lit(v) for v in grid])).alias("k")
    rows = flows.select(*keep, "ppi_len", "z", k)
    at = F.col("k")
    if indexing == "effective":
        at = F.greatest(F.least(at, F.col("ppi_len"), F.lit(S.K_MAX)), F.lit(1))
    return rows.select(*keep, "k", F.posexplode(logits_at(F.col("z"), at, n_classes)).alias("c", "z"))


def from_outputs(outputs: dict[int | None, DataFrame], indexing: str) -> DataFrame:
    """Long logits from per-K outputs ({k: (flow_id, c, z)}) or one causal output ({None: …})."""
    parts = []
    for k, df in outputs.items():
        part = df if k is None else df.withColumn("k", F.lit(int(k)))
        parts.append(part.select("flow_id", "k", "c", "z"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("indexing", F.lit(indexing))


def _zk_struct(zk: Column, adjustment: Sequence[float] | None, t: Column) -> Column:
    adj = zk
    if adjustment is not None:
        shift = F.array(*[F.lit(float(a)) for a in adjustment])
        adj = F.zip_with(zk, shift, lambda a, b: a + b)
    return F.struct(
        zk.alias("raw"), adj.alias("adj"), F.array_max(adj).alias("m"), F.array_max(zk).alias("mr"), t.alias("t")
    )


def _sum_exp(values: Column, m: Column, t: Column | float) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.exp((v - m) / t))


def class_scores(
    flows: DataFrame,
    n_classes: int,
    adjustment: Sequence[float] | None = None,
    temperatures: Sequence[float] | None = None,
    digits: int | None = None,
) -> DataFrame:
    """From flat logits ``z``: pred, pred_raw, conf, margin, energy, energy_raw per prefix.

    The lowest class wins a tie. Positions past a flow's end repeat its last prefix.
    """
    temps = temperatures or [1.0] * S.K_MAX
    ks = F.sequence(F.lit(1), F.lit(S.K_MAX))
    read = lambda k: F.greatest(F.least(k, F.col("ppi_len")), F.lit(1))
    tk = F.array(*[F.lit(float(t)) for t in temps])
    step1 = F.transform(
        ks,
        lambda k: _zk_struct(
            logits_at(F.col("z"), read(k), n_classes), adjustment, F.element_at(tk, read(k).cast("int"))
        ),
    )
    step2 = F.transform(
        step1,
        lambda s: F.struct(
            (F.array_position(s["adj"], s["m"]) - 1).cast("int").alias("pred"),
            (F.array_position(s["raw"], s["mr"]) - 1).cast("int").alias("pred_raw"),
            _sum_exp(s["adj"], s["m"], s["t"]).alias("se"),
            _sum_exp(s["raw"], s["mr"], F.lit(1.0)).alias("ser"),
            F.exp((F.element_at(F.sort_array(s["adj"], asc=False), 2) - s["m"]) / s["t"]).alias("second"),
            s["m"].alias("m"),
            s["mr"].alias("mr"),
            s["t"].alias("t"),
        ),
    )
    rd = lambda c: rounded_column(c, digits)
    step3 = F.transform(
        step2,
        lambda s: F.struct(
            s["pred"].alias("pred"),
            s["pred_raw"].alias("pred_raw"),
            rd(F.lit(1.0) / s["se"]).alias("conf"),
            rd((F.lit(1.0) - s["second"]) / s["se"]).alias("margin"),
            rd(-s["t"] * (s["m"] / s["t"] + F.log(s["se"]))).alias("energy"),
            rd(-(s["mr"] + F.log(s["ser"]))).alias("energy_raw"),
        ),
    )
    names = ["pred", "pred_raw", "conf", "margin", "energy", "energy_raw"]
    keep = [c for c in flows.columns if c != "z"]
    staged = flows.select(*keep, "z", step3.alias("_s"))
    return staged.select(*keep, "z", *[F.col(f"_s.{n}").alias(n) for n in names])


def running_surprise(nll: Column, ppi_len: Column, digits: int | None = None) -> Column:
    """Mean next-packet NLL over packets 2..k (0 at k = 1), carried past the flow's end."""
    none = F.array().cast("array<double>")
    start = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("s"), none.alias("out"))

    def step(acc: Column, v: Column) -> Column:
        i = acc["i"] + 1
        total = acc["s"] + F.when((i >= 2) & (i <= ppi_len), v).otherwise(F.lit(0.0))
        n = F.least(i, ppi_len) - 1
        mean = F.when(n > 0, total / n).otherwise(F.lit(0.0))
        mean = rounded_column(mean, digits)
        return F.struct(
            i.alias("i"), total.alias("s"), F.concat(acc["out"], F.array(mean)).alias("out")
        )

    return F.aggregate(nll, start, step)["out"]


def long_scores(scores: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per (flow, k) with the named score arrays as scalars."""
    zipped = F.arrays_zip(*[F.col(n) for n in names])
    return scores.select(*keep, F.posexplode(zipped).alias("_k", "_v")).select(
        *keep, (F.col("_k") + 1).alias("k"), *[F.col(f"_v.{n}").alias(n) for n in names]
    )


def reached(rows: DataFrame) -> DataFrame:
    """Long rows of prefixes the flow really has."""
    return rows.where(F.col("k") <= F.col("ppi_len"))


def concat(parts: Sequence[DataFrame]) -> DataFrame:
    if not parts:
        raise ValueError("nothing to concatenate")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def known_only(scores: DataFrame) -> DataFrame:
    return scores.where(F.col("label") >= 0)


def exact_text(value: Column) -> Column:
    """A double as text, exact to its last bit and alike on every engine: sign, the 53 bits of its significand as a
    whole number, and the power of two. Both zeros are ``0``, every NaN is ``nan``."""
    a = F.abs(value.cast("double"))
    guess = F.floor(F.log2(a)).cast("int")
    # a logarithm may be off by one next to a power of two
    power = guess - (F.pow(F.lit(2.0), guess) > a).cast("int") + (F.pow(F.lit(2.0), guess + 1) <= a).cast("int")
    power = F.when(a < 2.0**-1021, F.lit(-1022)).when(a >= 2.0**1023, F.lit(1023)).otherwise(power)
    shift = F.lit(52) - power
    half = F.floor(shift / 2)
    whole = (a * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), shift - half)).cast("bigint")
    finite = F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("")), whole.cast("string"), F.lit("p"), power.cast("string"))
    return (
        F.when(F.isnan(value), F.lit("nan"))
        .when(a == float("inf"), F.when(value < 0, F.lit("-inf")).otherwise(F.lit("inf")))
        .when(a == 0, F.lit("0"))
        .otherwise(finite)
    )


def _value_text(value: Column, kind: T.DataType) -> Column:
    """A value as text from which it can be told exactly; NULL is ``-``."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        text = exact_text(value)
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.concat_ws(",", F.transform(value, lambda v: _value_text(v, kind.elementType))), F.lit("]"))
    elif isinstance(kind, T.StructType):
        fields = F.concat_ws(",", *[_value_text(value[f.name], f.dataType) for f in kind.fields])
        text = F.when(value.isNotNull(), F.concat(F.lit("("), fields, F.lit(")")))
    elif isinstance(kind, T.MapType):
        text = _value_text(F.array_sort(F.map_entries(value)), T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])))
    elif isinstance(kind, T.BinaryType):
        text = F.lower(F.hex(value))
    elif isinstance(kind, T.StringType):
        text = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("-"))


def content_hash(df: DataFrame) -> DataFrame:
    """Hash of a table as a multiset of rows: the number of rows and two independent 60-bit sums.

    Nothing is rounded: the last bit of a double counts. The order of rows and columns does not. The sums are of
    the first and the next 15 hex digits of the MD5 of a row's values (columns by name), modulo 2^60, so
    repeated rows do not cancel out.
    """
    texts = [_value_text(F.col(f"`{f.name}`"), f.dataType) for f in sorted(df.schema.fields, key=lambda f: f.name)]
    digest = df.select(F.md5(F.concat_ws(",", *texts)).alias("d"))
    part = lambda at: F.conv(F.substring("d", at, 15), 16, 10).cast("decimal(20,0)")
    return digest.agg(
        F.count("*").alias("n_rows"),
        *[F.coalesce(F.sum(part(at)) % F.lit(2**60).cast("decimal(20,0)"), F.lit(0)).cast("bigint").alias(n) for n, at in (("hash_a", 1), ("hash_b", 16))],
    )


# --- Gaussian statistics of a projection -------------------------------------------------------


def class_validity(train: DataFrame, min_flows: int = 50) -> DataFrame:
    """(k, label, n) of classes with at least ``min_flows`` training flows that reached K."""
    per = train.groupBy("label", "ppi_len").agg(F.count("*").alias("n"))
    ks = F.explode(F.sequence(F.lit(1), F.least(F.col("ppi_len"), F.lit(S.K_MAX)))).alias("k")
    return (
        per.select("label", "n", ks).groupBy("k", "label").agg(F.sum("n").alias("n")).where(F.col("n") >= min_flows)
    )


def em_projection(x: np.ndarray, dim: int = 2 * S.K_MAX) -> np.ndarray:
    """[n, 30, dim]: per K the features its packets have filled, two each, and zeros behind them."""
    filled = np.arange(dim)[None] < 2 * np.arange(1, S.K_MAX + 1)[:, None]
    return x[:, None, :dim] * filled[None]


def gaussian_sums(train: DataFrame, project: Callable[[np.ndarray], np.ndarray], full: bool = True) -> DataFrame:
    """Moments per (k, label) as rows (k, label, i, j, v): the count at (0, 0), the sum of x_i at (i, 0), the sum
    of x_i x_j at i <= j, numbered from 1; without ``full`` only i = j. Flows count at the K they reached.

    A task adds up its own rows and sends one set of numbers per (k, label), whatever its size. A flow of an
    unknown class raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            label, length = (b.column(c).to_numpy() for c in ("label", "ppi_len"))
            if (label < 0).any():
                raise ValueError("a Gaussian fit takes flows of known classes only")
            x = _matrix(b.column("x")).astype(np.float64) if b.num_rows else np.zeros((0, 1))
            for i in range(0, b.num_rows, SLICE):
                own = slice(i, i + SLICE)
                reached = np.arange(1, S.K_MAX + 1)[None] <= length[own, None]
                seen = project(x[own]) * reached[..., None]
                for c in np.unique(label[own]).tolist():
                    mine = label[own] == c
                    v = seen[mine]
                    square = np.einsum("nkd,nke->kde", v, v) if full else np.einsum("nkd,nkd->kd", v, v)
                    parts = [reached[mine].sum(0).astype(float), v.sum(0), square]
                    held[c] = [p + q for p, q in zip(held[c], parts, strict=True)] if c in held else parts
        for c, (n, total, square) in held.items():
            dim = total.shape[1]
            i, j = np.triu_indices(dim) if full else (np.arange(dim),) * 2
            left = np.concatenate(([0], np.arange(1, dim + 1), i + 1))
            right = np.concatenate(([0], np.zeros(dim, int), j + 1))
            values = np.concatenate((n[:, None], total, square[:, i, j] if full else square), axis=1)
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(used + 1, len(left)), pa.int32()), pa.array(np.full(len(used) * len(left), c), pa.int32()),
                    pa.array(np.tile(left, len(used)), pa.int32()), pa.array(np.tile(right, len(used)), pa.int32()), pa.array(values[used].ravel()),
                ],
                names=["k", "label", "i", "j", "v"],
            )

    parts = train.select("x", "label", "ppi_len").mapInArrow(run, "k int, label int, i int, j int, v double")
    return parts.groupBy("k", "label", "i", "j").agg(F.sum("v").alias("v"))


class Distances(NamedTuple):
    """What a relative distance needs per K: the centres of the classes and, last, of all flows; the inverse
    spread inside classes and of all flows (matrices, or diagonals); which classes have enough flows."""

    centre: np.ndarray  # [30, C + 1, d]
    inverse: np.ndarray  # [30, 2, d, d] or [30, 2, d]
    enough: np.ndarray  # [30, C]

    def relative(self, seen: np.ndarray) -> np.ndarray:
        """[n, 30] from [n, 30, d]: the distance to the nearest class less that to all flows, 0 without a class."""
        out = np.zeros(seen.shape[:2])
        far = np.where(np.append(self.enough, np.ones((len(self.enough), 1), bool), axis=1), 0.0, np.inf)
        for i in range(0, len(seen), NEAR):
            gap = seen[i : i + NEAR, :, None] - self.centre[None]
            inside, overall = (self._size(g, side) for g, side in ((gap[:, :, :-1], 0), (gap[:, :, -1:], 1)))
            near = (inside + far[None, :, :-1]).min(axis=2, initial=np.inf)
            out[i : i + NEAR] = np.where(np.isfinite(near), near - overall[:, :, 0], 0.0)
        return out

    def _size(self, gap: np.ndarray, side: int) -> np.ndarray:
        inverse = self.inverse[:, side]
        turned = gap * inverse[None, :, None] if inverse.ndim == 2 else np.einsum("nkcd,kde->nkce", gap, inverse)
        return (turned * gap).sum(axis=-1)


def _shrunk_inverse(spread: np.ndarray, shrinkage: float) -> np.ndarray:
    """Inverses of matrices [.., d, d], or of diagonals [.., d], drawn towards their mean variance. In a diagonal,
    dimensions without spread count as zero and are left out."""
    if spread.ndim == 3:
        dim = spread.shape[-1]
        mean = np.trace(spread, axis1=1, axis2=2)[:, None, None] / dim
        return np.linalg.inv((1 - shrinkage) * spread + shrinkage * mean * np.eye(dim))
    live = spread > 1e-15
    mean = np.where(live, spread, 0.0).sum(-1, keepdims=True) / np.maximum(live.sum(-1, keepdims=True), 1)
    drawn = (1 - shrinkage) * spread + shrinkage * mean
    return np.where(live, 1.0 / np.where(live, drawn, 1.0), 0.0)


def fit_distances(sums: DataFrame, n_classes: int, dim: int, min_flows: int = 50, shrinkage: float = 0.1) -> Distances:
    """Distances from the moments of ``gaussian_sums``; 30 x classes x dimensions^2 numbers at most come back.

    The spread inside classes pools the classes with enough flows and loses a degree of freedom to each. A K at
    which nothing can be said keeps unit spread.
    """
    got = sums.toArrow()
    k, c, i, j = (got.column(n).to_numpy() for n in ("k", "label", "i", "j"))
    v = got.column("v").to_numpy()
    full = bool(((j > 0) & (i != j)).any())
    n, total = np.zeros((S.K_MAX, n_classes)), np.zeros((S.K_MAX, n_classes, dim))
    square = np.zeros((S.K_MAX, n_classes, dim, dim) if full else (S.K_MAX, n_classes, dim))
    at, one, two = i == 0, (i > 0) & (j == 0), j > 0
    n[k[at] - 1, c[at]] = v[at]
    total[k[one] - 1, c[one], i[one] - 1] = v[one]
    if full:
        for a, b in ((i, j), (j, i)):
            square[k[two] - 1, c[two], a[two] - 1, b[two] - 1] = v[two]
    else:
        square[k[two] - 1, c[two], i[two] - 1] = v[two]
    outer = (lambda x: x[..., :, None] * x[..., None, :]) if full else np.square
    wide = (slice(None),) + (None,) * (square.ndim - 2)
    enough = n >= min_flows
    mean = total / np.maximum(n, 1)[..., None]
    counted = np.where(enough, n, 0.0)
    kept = counted.reshape(counted.shape + (1,) * (square.ndim - 2))
    inside = (np.where(kept > 0, square, 0.0) - kept * outer(mean)).sum(axis=1)
    freedom = counted.sum(1) - enough.sum(1)
    every = n.sum(1)
    middle = total.sum(1) / np.maximum(every, 1)[:, None]
    overall = square.sum(1) / np.maximum(every, 1)[wide] - outer(middle)
    unit = np.eye(dim) if full else np.ones(dim)
    pair = [
        np.where((known > 0)[wide], _shrunk_inverse(np.where((known > 0)[wide], spread, unit), shrinkage), unit)
        for known, spread in ((np.maximum(freedom, 0), inside / np.maximum(freedom, 1)[wide]), (np.maximum(every - 1, 0), overall))
    ]
    # without freedom there is no spread to measure a class by, and without two flows no middle
    centre = np.concatenate((np.where((enough & (freedom > 0)[:, None])[..., None], mean, 0.0), np.where(every > 1, 1.0, 0.0)[:, None, None] * middle[:, None]), axis=1)
    return Distances(centre, np.stack(pair, axis=1), enough)


def add_mahal(flows: DataFrame, distances: Distances) -> DataFrame:
    """Adds ``mahal``: the relative distance of every prefix, carried past the flow's end."""
    cols = flows.columns
    out = T.StructType([*flows.schema.fields, T.StructField("mahal", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            x = _matrix(b.column("x")).astype(np.float64)
            last = np.clip(b.column("ppi_len").to_numpy(), 1, S.K_MAX)
            at = np.minimum(np.arange(S.K_MAX)[None], last[:, None] - 1)
            m = np.take_along_axis(distances.relative(em_projection(x, distances.centre.shape[2])), at, axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, _arrays(m)], names=[*cols, "mahal"])

    return flows.mapInArrow(run, out)


# --- the score pass -----------------------------------------------------------------------------


@dataclass(frozen=True)
class ScoreModel:
    """Everything a score pass applies: a scorer and whatever has been fitted on top of it.

    ``moments`` is [30, 3, 2] (mean, deviation) of energy, distance and surprise; a deviation of
    infinity makes a signal contribute 0.
    """

    scorer: Scorer
    adjustment: np.ndarray | None = None
    temperatures: np.ndarray | None = None
    bank: Distances | None = None
    moments: np.ndarray | None = None
    weights: tuple[float, float, float] = (1.0, 1.0, 0.5)
    digits: int | None = None
    #: of the running surprise: with few, half of the means over two packets would be exact ties
    mean_digits: int | None = None

    def columns(self, x: np.ndarray, ppi_len: np.ndarray) -> dict[str, np.ndarray]:
        """Score arrays [n, 30] of a batch; positions past a flow's end repeat its last prefix."""
        n = len(x)
        last = np.clip(ppi_len, 1, S.K_MAX)
        at = np.minimum(np.arange(S.K_MAX)[None], last[:, None] - 1)
        rows = np.arange(n)[:, None]
        raw = self.scorer.logits(x)[rows, at]
        adj = raw if self.adjustment is None else raw + self.adjustment
        t = np.ones(S.K_MAX) if self.temperatures is None else np.asarray(self.temperatures)
        t = t[at][..., None]
        m = adj.max(-1, keepdims=True)
        e = np.exp((adj - m) / t)
        total = e.sum(-1)
        second = np.sort(adj, axis=-1)[..., -2]
        mr = raw.max(-1, keepdims=True)
        out = {
            "pred": adj.argmax(-1),
            "pred_raw": raw.argmax(-1),
            "conf": 1.0 / total,
            "margin": (1.0 - np.exp((second - m[..., 0]) / t[..., 0])) / total,
            "energy": -t[..., 0] * (m[..., 0] / t[..., 0] + np.log(total)),
            "energy_raw": -(mr[..., 0] + np.log(np.exp(raw - mr).sum(-1))),
        }
        for c in ("conf", "margin", "energy", "energy_raw"):
            out[c] = rounded(out[c], self.digits)
        out["p_safe"] = out["conf"]
        # without a next-packet head the surprise of a packet is the doubt left after it
        valid = (np.arange(S.K_MAX)[None] >= 1) & (np.arange(S.K_MAX)[None] < last[:, None])
        run = np.cumsum(np.where(valid, 1.0 - out["conf"], 0.0), axis=1)
        count = np.cumsum(valid, axis=1)
        out["surprise"] = rounded(np.where(count > 0, run / np.maximum(count, 1), 0.0), self.mean_digits)
        if self.bank is not None:
            seen = em_projection(x, self.bank.centre.shape[2])
            out["mahal"] = rounded(self.bank.relative(seen)[rows, at], self.digits)
        if self.moments is not None:
            # past a flow's end the position keeps its own K's moments, as the arrays are per K
            z = [(out[s] - self.moments[:, j, 0]) / self.moments[:, j, 1] for j, s in enumerate(SIGNALS)]
            out["z_energy"] = rounded(z[0], self.digits)
            out["u"] = rounded(sum(w * v for w, v in zip(self.weights, z, strict=True)), self.digits)
        return out



INT_COLUMNS = ("pred", "pred_raw")


def score_flows(flows: DataFrame, model: ScoreModel, x: str = "x") -> DataFrame:
    """The batch score pass: one Arrow stage from features to every score array."""
    names = ["pred", "pred_raw", "conf", "margin", "energy", "energy_raw", "p_safe", "surprise"]
    names += ["mahal"] if model.bank is not None else []
    names += ["z_energy", "u"] if model.moments is not None else []
    keep = [c for c in flows.columns if c != x]

    def kind(c: str) -> T.ArrayType:
        return T.ArrayType(T.IntegerType() if c in INT_COLUMNS else T.DoubleType())

    out = T.StructType([flows.schema[c] for c in keep] + [T.StructField(c, kind(c)) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            cols = model.columns(_matrix(b.column(x)).astype(np.float64), b.column("ppi_len").to_numpy())
            made = [
                _arrays(cols[c].astype(np.int32) if c in INT_COLUMNS else cols[c] + 0.0) for c in names
            ]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + made, names=[*keep, *names])

    return flows.select(*keep, x).mapInArrow(run, out)


# --- the combined unknown score -----------------------------------------------------------------

SIGNALS = ("energy", "mahal", "surprise")
WEIGHTS = (1.0, 1.0, 0.5)


def signal_moments(val: DataFrame) -> DataFrame:
    """(k, signal means and deviations) over known validation flows that reached K."""
    rows = reached(long_scores(known_only(val), SIGNALS, ["ppi_len"]))
    aggs = []
    for s in SIGNALS:
        sd = F.stddev_pop(s)
        aggs += [
            F.avg(s).alias(f"{s}_mean"),
            F.when((sd > 1e-8) & (F.count("*") >= 2), sd).alias(f"{s}_std"),
        ]
    return rows.groupBy("k").agg(*aggs)


def moments_array(moments: DataFrame) -> np.ndarray:
    """The 30 x 3 x 2 moments as a driver-side array for ``ScoreModel``."""
    out = np.zeros((S.K_MAX, len(SIGNALS), 2))
    out[:, :, 1] = np.inf
    for r in moments.collect():
        for j, s in enumerate(SIGNALS):
            if r[f"{s}_std"] is not None:
                out[r["k"] - 1, j] = r[f"{s}_mean"], r[f"{s}_std"]
    return out


def combined_score(scores: DataFrame, moments: DataFrame, digits: int | None = None) -> DataFrame:
    """Adds ``u`` and ``z_energy``. A constant or unseen signal contributes 0.

    ``moments`` has one row per K, so it travels as one broadcast row.
    """
    fields = [f"{s}_{p}" for s in SIGNALS for p in ("mean", "std")]
    one = moments.agg(
        F.map_from_entries(F.collect_list(F.struct("k", F.struct(*fields)))).alias("_m")
    )

    def z(signal: Column, name: str, k: Column) -> Column:
        par = F.col("_m")[k]
        return F.coalesce((signal - par[f"{name}_mean"]) / par[f"{name}_std"], F.lit(0.0))

    zipped = F.arrays_zip(*[F.col(s) for s in SIGNALS])
    u = F.transform(
        zipped,
        lambda v, i: rounded_column(
            sum((F.lit(w) * z(v[s], s, i + 1) for s, w in zip(SIGNALS[1:], WEIGHTS[1:], strict=True)),
                F.lit(WEIGHTS[0]) * z(v["energy"], "energy", i + 1)),
            digits,
        ),
    )
    ze = F.transform(F.col("energy"), lambda v, i: rounded_column(z(v, "energy", i + 1), digits))
    return scores.crossJoin(F.broadcast(one)).withColumns({"u": u, "z_energy": ze}).drop("_m")


def reject_thresholds(val: DataFrame, fs: Sequence[float], signal: str = "u", digits: int | None = None) -> DataFrame:
    """(k, f, theta): the 1 - f quantile of ``signal`` over known validation flows reaching K."""
    from flowtide.operators.ordered import exact_quantiles

    for f in fs:
        if not 0.0 < f < 1.0:
            raise ValueError(f"f must be in (0, 1), got {f}")
    rows = reached(long_scores(known_only(val), [signal], ["ppi_len"]))
    enough = rows.groupBy("k").agg(F.count("*").alias("n")).where("n >= 2").select("k")
    q = exact_quantiles(rows, ["k"], signal, [1.0 - f for f in fs])
    return q.join(F.broadcast(enough), "k", "left_semi").select(
        "k", F.round(F.lit(1.0) - F.col("prob"), 9).alias("f"), rounded_column(F.col("quantile"), digits).alias("theta")
    )


def theta_array(thresholds: DataFrame, f: float) -> list[float | None]:
    """The 30 thresholds of one ``f`` as a small list; None = never reject at that K."""
    out: list[float | None] = [None] * S.K_MAX
    for r in thresholds.where(F.abs(F.col("f") - F.lit(f)) < 1e-9).collect():
        out[r["k"] - 1] = r["theta"]
    return out


def first_rejection(u: Column, theta: Sequence[float | None], last: Column, k_ood: int = 3) -> Column:
    """First K in [k_ood, last] with u_k >= theta_k; 0 where none."""
    th = F.array(*[F.lit(t).cast("double") for t in theta])
    hit = F.transform(
        u,
        lambda v, i: F.coalesce(v >= F.element_at(th, (i + 1).cast("int")), F.lit(False))
        & (i + 1 >= k_ood)
        & (i + 1 <= last),
    )
    return F.array_position(hit, True).cast("int")


# --- next-packet likelihood ---------------------------------------------------------------------

CHANNEL_VOCAB = {"size": S.SIZE_TOKENS, "ipt": S.IPT_TOKENS, "dir": 2}


def transition_counts(train: DataFrame) -> DataFrame:
    """(channel, prev, next, n): how often a token follows another in training flows."""
    pairs = _token_pairs(train)
    parts = [
        pairs.groupBy(F.col(f"prev_{c}").alias("prev"), F.col(f"next_{c}").alias("next"))
        .agg(F.count("*").alias("n"))
        .select(F.lit(c).alias("channel"), "prev", "next", "n")
        for c in CHANNEL_VOCAB
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _token_pairs(flows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per neighbouring pair of packets; ``j`` is the position of the later one."""
    toks = P.tokens(F.col("ppi"))
    n = F.size("_t")
    pair = F.zip_with(
        F.slice("_t", F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.slice("_t", F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )
    return (
        flows.select(*keep, toks.alias("_t"))
        .select(*keep, F.posexplode(pair).alias("_j", "_p"))
        .select(
            *keep,
            (F.col("_j") + 2).alias("j"),
            *[F.col(f"_p.a.{c}").alias(f"prev_{c}") for c in CHANNEL_VOCAB],
            *[F.col(f"_p.b.{c}").alias(f"next_{c}") for c in CHANNEL_VOCAB],
        )
    )


def next_packet_scores(flows: DataFrame, counts: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(flow_id, j, nll, entropy) of packet ``j`` given packet ``j - 1``.

    P(next | current) is a smoothed transition frequency per channel. The count tables hold at
    most 64 x 64 rows a channel, so they are broadcast. NLLs of the channels are summed, the
    entropies, each divided by the log of its vocabulary, are averaged.
    """
    rows = _token_pairs(flows, ["flow_id"])
    nll, ent = F.lit(0.0), F.lit(0.0)
    for c, v in CHANNEL_VOCAB.items():
        mine = counts.where(F.col("channel") == c)
        total = mine.groupBy("prev").agg(F.sum("n").alias("_n"))
        p = (F.col("n") + alpha) / (F.col("_n") + alpha * v)
        unseen = F.lit(alpha) / (F.col("_n") + alpha * v)
        state = (
            mine.join(total, "prev")
            .groupBy("prev")
            .agg(
                F.max("_n").alias(f"_n_{c}"),
                (
                    F.sum(-p * F.log(p))
                    - (F.lit(v) - F.count("*")) * F.max(unseen * F.log(unseen))
                ).alias(f"_h_{c}"),
            )
            .withColumnRenamed("prev", f"prev_{c}")
        )
        pairs = mine.select(
            F.col("prev").alias(f"prev_{c}"), F.col("next").alias(f"next_{c}"), F.col("n").alias(f"_c_{c}")
        )
        rows = rows.join(F.broadcast(pairs), [f"prev_{c}", f"next_{c}"], "left").join(
            F.broadcast(state), [f"prev_{c}"], "left"
        )
        seen = F.coalesce(f"_c_{c}", F.lit(0)) + alpha
        nll = nll - F.log(seen / (F.coalesce(f"_n_{c}", F.lit(0)) + alpha * v))
        ent = ent + F.coalesce(F.col(f"_h_{c}") / F.log(F.lit(float(v))), F.lit(1.0))
    return rows.select("flow_id", "j", nll.alias("nll"), (ent / len(CHANNEL_VOCAB)).alias("entropy"))


# --- embedding probes ---------------------------------------------------------------------------


def nearest_vote(reference: DataFrame, queries: DataFrame, k: int = 20, block: int = 4096, digits: int | None = None) -> DataFrame:
    """Majority class of the ``k`` most similar reference rows other than itself (cosine of unit vectors), for a
    stated set of query rows.

    Both sides are cut into blocks; a task multiplies one pair of blocks as matrices and keeps k
    rows per query, so no task holds more than two blocks and no list of all pairs exists.
    """
    r, q = reference.agg(F.count("*")).first()[0], queries.agg(F.count("*")).first()[0]
    nr, nq = max(1, -(-r // block)), max(1, -(-q // block))
    ref = reference.select(
        F.pmod(F.xxhash64("flow_id"), F.lit(nr)).cast("int").alias("br"),
        F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("bq"),
        "flow_id", "class_id", "x",
    )
    que = queries.select(
        F.pmod(F.xxhash64("flow_id"), F.lit(nq)).cast("int").alias("bq"),
        F.explode(F.sequence(F.lit(0), F.lit(nr - 1))).alias("br"),
        "flow_id", "x",
    )
    out = "query bigint, ref bigint, class_id int, sim double"

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        qi, ri = left.column("flow_id").to_numpy(), right.column("flow_id").to_numpy()
        names = ["query", "ref", "class_id", "sim"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.float64()]
        if len(qi) == 0 or len(ri) == 0:
            return pa.Table.from_arrays([pa.array([], t) for t in types], names=names)
        sim = rounded(_matrix(left.column("x")) @ _matrix(right.column("x")).T, digits)
        sim[qi[:, None] == ri[None]] = -np.inf
        order = np.lexsort((np.broadcast_to(ri, sim.shape), -sim), axis=1)[:, :k]
        y = right.column("class_id").to_numpy()
        cols = [np.repeat(qi, order.shape[1]), ri[order].ravel(), y[order].ravel()]
        cols.append(np.take_along_axis(sim, order, axis=1).ravel())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    pairs = que.groupBy("bq", "br").cogroup(ref.groupBy("bq", "br")).applyInArrow(best, out)
    from pyspark.sql import Window as W

    w = W.partitionBy("query").orderBy(F.col("sim").desc(), F.col("ref"))
    votes = (
        pairs.where("sim > double('-infinity')")
        .withColumn("_r", F.row_number().over(w))
        .where(F.col("_r") <= k)
        .groupBy("query", "class_id")
        .agg(F.count("*").alias("votes"))
    )
    return votes.groupBy("query").agg(
        F.max_by("class_id", F.struct("votes", -F.col("class_id"))).alias("pred"),
        F.max("votes").alias("votes"),
    )


def uniformity(rows: DataFrame, group: Column) -> DataFrame:
    """log of the mean exp(-2 |u - v|^2) over the pairs inside groups, as for batches of a training run.

    ``group`` deals the rows into groups of bounded size, which the caller chooses; all pairs of a large table would
    be no distributed job. Sums per group are added up.
    """
    dealt = rows.select(group.alias("_g"), "x")

    def total(part: pa.Table) -> pa.Table:
        u = _matrix(part.column("x"))
        size = (u * u).sum(1)
        near = np.exp(-2.0 * (size[:, None] + size[None] - 2.0 * (u @ u.T)))
        n = len(u) * (len(u) - 1)
        return pa.table({"s": pa.array([float(near.sum() - np.trace(near))]), "n": pa.array([n], pa.int64())})

    parts = dealt.groupBy("_g").applyInArrow(total, "s double, n bigint")
    return parts.agg(F.log(F.sum("s") / F.sum("n")).alias("uniformity"), F.sum("n").alias("n_pairs"))
