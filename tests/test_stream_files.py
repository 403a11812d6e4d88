"""A slice of a written stream is one micro-batch, however many files it has."""

import pytest
from pyspark.sql import functions as F

from flowtide.session import scratch_path
from flowtide.streaming import replay as RP
from flowtide.streaming import run as RUN


@pytest.mark.parametrize("keys", [1, 40])
def test_slices_are_micro_batches(spark, monkeypatch, keys) -> None:
    monkeypatch.setattr(RP, "FILE_ROWS", 50)
    rows = spark.range(600).select((F.col("id") % keys).alias("key"), "id")
    path = scratch_path(spark, "slices")
    files = RP.write_in_order(rows, path, F.col("id"), 3, "key")
    assert files == 4
    assert len(spark.read.parquet(path).inputFiles()) == 3 * files
    seen: list[tuple[int, int, int]] = []

    def note(batch, batch_id: int) -> None:
        seen.append((batch_id, *batch.agg(F.min("id"), F.max("id")).first()))

    RUN.run_batches(RP.read_stream(spark, path, rows.schema, files), note, "slices")
    assert [s[0] for s in seen] == [0, 1, 2]
    assert seen[0][1] == 0 and seen[2][2] == 599
    assert all(a[2] < b[1] for a, b in zip(seen, seen[1:], strict=False))
    assert spark.read.parquet(path).count() == 600
