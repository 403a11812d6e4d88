"""A cross-section of the registered queries next to their SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry_module
from tools.check import TABLES, norm

CHECKED = [
    "flow_fin_linger", "flow_end_reason", "flow_statistics", "prefix_stats_grid", "flow_tokens", "standardizer_fit", "packet_drop",
    "neighbour_swap", "csv_sequence_parse", "capture_to_flows", "split_boundary_trim", "open_set_draw", "score_pass",
    "reject_thresholds", "macro_f1", "auroc", "safe_stop", "threshold_sweep", "window_signals", "cusum_alarms", "rolling_stats",
    "paired_difference", "session_windows",
]


def test_every_sql_belongs_to_a_query():
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 180


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, sf, name):
    df = entry_module.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*cols).collect())
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    idx = [names.index(c) for c in cols]
    want = sorted(tuple(norm(r[i]) for i in idx) for r in cur.fetchall())
    assert got == want


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() > 0


def test_an_absent_package_leaves_the_other_queries(monkeypatch, capsys):
    import sys

    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("flowtide.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "zstandard", None)
    names = entry_module.queries()
    assert len(names) > 180 and "pipeline" not in names and set(entry_module.oracle_sql()) <= set(names)
