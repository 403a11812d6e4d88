"""The registered queries and the pipeline."""

from __future__ import annotations

from collections import defaultdict

import duckdb
import plain
import pytest

import __spark_entry__ as entry_module
import corpus_pipeline
from flowtide.llm import langid, tokens
from flowtide.llm.common import prepare
from tools.check import TABLES, norm

SQL = ["op3_exact_dedup", "op4_warc", "op7_secrets", "op10_decontamination", "op11_phrase_collocations", "op12_jaccard_join", "op13_merkle_manifest"]


def test_all_are_registered():
    names = entry_module.queries()
    assert "pipeline" in names
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13


@pytest.mark.parametrize("name", SQL)
def test_query_equals_its_sql(spark, sf, name):
    df = entry_module.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*cols).collect())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    idx = [names.index(c) for c in cols]
    assert got == sorted(tuple(norm(r[i]) for i in idx) for r in cur.fetchall())


def test_pipeline(spark, sf):
    from tokenizers import Tokenizer

    docs = prepare(spark).read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rejected = {r["doc_id"] for r in langid.identify(docs).where("rejected").collect()}
    rows = [(i, t) for i, t in rows if i not in rejected]
    kept = plain.exact(rows)
    rows = [(i, t) for i, t in rows if kept[i][2]]
    near = plain.components(rows)
    rows = [(i, t) for i, t in rows if near[i][1] == i]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = plain.contamination(rows, items)
    rows = [(i, t) for i, t in rows if not bad[i][3]]
    tok = Tokenizer.from_file(tokens.vocabulary_path())
    want = {i: plain.token_ids(tok, t) for i, t in rows}
    got, places = defaultdict(int), defaultdict(list)
    for r in corpus_pipeline.run(spark, sf).collect():
        assert plain.crc(want[r["doc_id"]][r["start"] : r["start"] + r["length"]]) == r["ids_crc32"]
        got[r["doc_id"]] += r["length"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == {i: len(x) for i, x in want.items()}
    for parts in places.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 4096
