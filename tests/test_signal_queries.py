"""Queries over windows and weeks fit the score model once and share its rows."""

import pytest

from flowtide.plans import drift as P


@pytest.fixture()
def asked(spark, monkeypatch):
    """Five weeks of two windows; the list holds every call for score rows."""
    calls = []
    weeks = [(2 * p + i, p, *[float(p + j) for j in range(len(P.SIGNALS))]) for p in range(5) for i in (0, 1)]
    windows = spark.createDataFrame(weeks, "window_id long, period int, " + ", ".join(f"{s} double" for s in P.SIGNALS))
    decay = spark.createDataFrame([(p, 1.0 - p / 10) for p in range(5)], "period int, policy_macro_f1 double")
    rows = spark.range(1)
    monkeypatch.setattr(P, "em_scores", lambda spark, sf: calls.append(sf) or rows)
    monkeypatch.setattr(P, "em_windows", lambda s: windows if s is rows else None)
    monkeypatch.setattr(P, "em_decay", lambda s: decay if s is rows else None)
    return calls


def test_signal_validation_asks_for_score_rows_once(spark, asked):
    got = {r["signal"]: (r["spearman"], r["n"]) for r in P.signal_validation(spark, "nowhere").collect()}
    assert got == {s: (-1.0, 5) for s in P.SIGNALS}
    assert asked == ["nowhere"]


def test_lead_weeks_asks_for_score_rows_once(spark, asked):
    r = P.lead_weeks(spark, "nowhere").first()
    assert (round(r["floor"], 6), r["first_below"]) == (0.92, 2)
    assert asked == ["nowhere"]
