"""What a task of the score pass holds does not grow with classes x prefixes x flows of a batch."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from flowtide import schema as S
from flowtide.operators import scores as C


def _distances(rng: np.random.Generator, classes: int = 8, dim: int = 60) -> C.Distances:
    centre = rng.normal(size=(S.K_MAX, classes + 1, dim))
    inverse = rng.uniform(0.5, 2.0, size=(S.K_MAX, 2, dim))
    enough = rng.random((S.K_MAX, classes)) < 0.8
    enough[0] = False
    return C.Distances(centre, inverse, enough)


def test_relative_distance_is_worked_out_in_small_slices() -> None:
    rng = np.random.default_rng(3)
    bank = _distances(rng)
    seen = C.em_projection(rng.normal(size=(C.SLICE + 7, 60)))
    tracemalloc.start()
    got = bank.relative(seen)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20
    gap = seen[::97, :, None] - bank.centre[None]
    far = np.where(bank.enough, 0.0, np.inf)
    near = ((gap[:, :, :-1] * bank.inverse[None, :, None, 0]) * gap[:, :, :-1]).sum(-1) + far[None]
    overall = ((gap[:, :, -1] * bank.inverse[None, :, 1]) * gap[:, :, -1]).sum(-1)
    want = np.where(bank.enough.any(1)[None], near.min(2) - overall, 0.0)
    np.testing.assert_allclose(got[::97], want, rtol=1e-12, atol=1e-9)


class _Task:
    """Stands for a table of flows and hands out what one of its tasks runs on batches."""

    schema = T.StructType(
        [T.StructField("flow_id", T.LongType()), T.StructField("ppi_len", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))]
    )
    columns = schema.names

    def select(self, *names: str) -> "_Task":
        return self

    def mapInArrow(self, run, out):
        return run


def _peak_of_a_batch(model: C.ScoreModel, n: int) -> int:
    rng = np.random.default_rng(n)
    x = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 60), pa.array(rng.normal(size=n * 60)))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(rng.integers(1, 40, n).astype(np.int32)), x], _Task.columns)
    run = C.score_flows(_Task(), model)
    tracemalloc.start()
    rows = sum(b.num_rows for b in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == n
    return peak


def test_score_pass_holds_as_much_for_a_large_batch_as_for_a_small_one() -> None:
    rng = np.random.default_rng(5)
    model = C.ScoreModel(C.CentroidScorer(rng.normal(size=(8, 60)), 1.0), bank=_distances(rng), moments=np.ones((S.K_MAX, 3, 2)))
    small, large = (_peak_of_a_batch(model, n) for n in (C.SLICE, 10_000))
    assert large < 1.5 * small
    assert large < 64 << 20
