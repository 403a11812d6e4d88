"""Phrases, the Jaccard join and the Merkle manifest against plain versions, and their edge cases."""

from __future__ import annotations

import random

import numpy as np
import plain
import pytest

from flowtide.llm import common, jaccard, merkle, phrases

DOCS = "doc_id long, text string, lang string, source string, n_chars long, token long, g string, block int, word string, n int"


def frame(spark, rows):
    """(doc_id, text, lang) rows in a table with further columns."""
    return common.prepare(spark).createDataFrame([(i, t, g, None, None, 1, "x", 2, "w", 3) for i, t, g in rows], DOCS)


def pieces(seed, n=250):
    """Texts of few words with all kinds of separators, a repeated passage and one very long piece."""
    r = random.Random(seed)
    words = ["".join(r.choice("aBcé|\x1c") for _ in range(r.randint(1, 3))) for _ in range(60)]
    passage = " ".join(r.choice(words) for _ in range(30))
    rows = [(0, None, "en"), (1, "", None), (2, " . ,", "de"), (3, "one", "fr"), (4, "x " * 5000, "en")]
    for i in range(5, n):
        t = "".join(r.choice(words[: r.choice([5, 20, 60])]) + r.choice([" "] * 8 + ["\t ", ",", "\n", "\r\n", "\x0b", ". "]) for _ in range(r.randint(1, 60)))
        rows.append((i, t + " " + passage if r.random() < 0.2 else t, r.choice(["en", "en", "de", None])))
    return rows


@pytest.mark.parametrize("settings", [{}, {"RANGE": 500, "FLUSH": 300, "KEYS": 4, "RANKED": 50}, {"SENT_WORDS": 0}])
def test_collocations(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(phrases, name, value)
    rows = pieces(5)
    got = sorted(tuple(x) for x in phrases.collocations(frame(spark, rows), least=8, top=150).collect())
    assert got == plain.collocations([(t, g) for _, t, g in rows], 8, 150)


def test_unary_paths_are_read_off_whole(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = frame(spark, [(i, text, "en") for i in range(3)] + [(3, "w3 w4 w5 w6 w7", "en")])
    texts = docs.selectExpr("lang", "cast(text as binary) as _t")
    words = phrases.Dictionary(texts, 3)
    paths = phrases.unary_paths(phrases.grams(texts, words, 3)).collect()
    # the edge that also stands elsewhere has another weight and parts the path
    assert sorted((len(p["words"]), p["f"]) for p in paths) == [(5, 4), (7, 3), (36, 3)]
    assert {r["phrase"] for r in phrases.collocations(docs, least=3, top=100).collect()} >= {"w3 w4 w5 w6 w7", "w35 w36 w37 w38 w39"}


def test_prefixes_of_edges_count_all_grams():
    words = np.array([1, 2, 1, 2, 1, 0, 3, 1, 2, 0], np.int64)
    found = {}
    for grams, counts in phrases.prefix_counts(phrases.summed([phrases.edges_of(words[:6]), phrases.edges_of(words[6:], 2)]), 1):
        found |= {tuple(x for x in g if x): c for g, c in zip(grams.tolist(), counts.tolist(), strict=True)}
    assert found == {
        (1,): 5, (2,): 4, (3,): 2, (1, 2): 4, (2, 1): 2, (3, 1): 2, (1, 2, 1): 2, (2, 1, 2): 1, (3, 1, 2): 2, (1, 2, 1, 2): 1, (2, 1, 2, 1): 1, (1, 2, 1, 2, 1): 1,
    }


def near(seed, n=300):
    """Texts that differ from a few others by single words, and texts with a shared passage."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdÉ") for _ in range(r.randint(1, 4))) for _ in range(200)]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    base, passage = [text(r.choice([1, 2, 3, 12, 40, 100, 300])) for _ in range(25)], text(60)
    rows = [(0, None), (1, ""), (2, " \n\x0b"), (3, text(20000))]
    for i in range(4, n):
        kind = r.random()
        if kind < 0.6:
            w = r.choice(base).split(" ")
            for _ in range(r.choice([0, 0, 1, 1, 1, 2, 3])):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append((i, " ".join(w)))
        elif kind < 0.8:
            rows.append((i, text(r.randint(1, 30)) + "\t" + passage + " " + text(r.randint(0, 5))))
        else:
            rows.append((i, text(r.randint(1, 60))))
    return rows


@pytest.mark.parametrize("settings", [{}, {"CENTRES": 0, "FREQUENT_GRAMS": 0, "FREQUENT_WORDS": 0, "SENT_IDS": 0, "FRAGMENTS": 3}])
def test_jaccard(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = near(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar(frame(spark, [(i, t, "en") for i, t in rows])).collect()}
    want = plain.jaccard(rows)
    assert got == want and len({c for _, c in want.values()}) < len(rows) - 50


def test_manifest(spark):
    r = random.Random(1)
    for sizes in ((1,), (8, 9, 65), (600, 513, 511, 512, *(1,) * 9)):
        rows = []
        for k, n in enumerate(sizes):
            for _ in range(n):
                i = len(rows) + 1
                rows.append((i * 7 % 99991, r.choice([None, "s", "ü"]), f"l{k}" if k else None, r.choice([None, i]), r.choice([None, "", "Éa B", "abc " * 2000])))
        table = spark.createDataFrame([(i, t, g, s, c, 1, "x", 2, "w", 3) for i, s, g, c, t in rows], DOCS)
        got = {x[0]: tuple(x[1:]) for x in merkle.tampered_manifest(table).collect()}
        assert got == plain.manifest(rows)


@pytest.mark.parametrize("name", ["jaccard", "manifest", "phrases"])
def test_empty_table_and_rows_that_repeat(spark, name):
    operator = {"jaccard": jaccard.similar, "manifest": merkle.tampered_manifest, "phrases": lambda d: phrases.collocations(d, least=2)}[name]
    assert operator(frame(spark, [])).collect() == []
    text = "The same words stand here twice"
    got = operator(frame(spark, [(1, text, "en"), (1, text, "en"), (2, text, None), (None, text, "en"), (None, None, None), (3, None, "en")])).collect()
    if name == "phrases":
        # five of six words are the longest phrase there is, twice over
        assert [(r["lang"], r["rank"], r["phrase"], r["a"], r["n"]) for r in got] == [
            ("en", 1, "same words stand here twice", 3, 18), ("en", 2, "the same words stand here", 3, 18),
        ]
        return
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "2", "3", "None", "None"]
    if name == "jaccard":
        assert sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in got) == [
            ("1", 4, 1), ("1", 4, 1), ("2", 4, 1), ("3", 0, 3), ("None", 0, None), ("None", 4, 1),
        ]
    else:
        assert len({r["root"] for r in got}) == 1 and len({r["subroot"] for r in got}) == 2
        assert len({r["leaf"] for r in got if r["doc_id"] == 1}) == 1
