"""How often panels are dealt out, and by how much rows grow for ICs."""

from __future__ import annotations

import numpy as np
from conftest import DATA

from factorloom import queries
from factorloom.functions import rolled
from factorloom.operators import evaluate
from factorloom.sources import panel as sources


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_panel_with_returns_is_dealt_out_once(spark):
    made = plan(sources.weekly_panel(spark, str(DATA / "sf0.001")))
    assert made.count("Exchange hashpartitioning") == 1


def test_ics_are_made_without_a_row_for_each_factor(spark):
    rows = [(d, a, float(a % 7), float(a * d % 5), float(a)) for d in (1, 2) for a in range(20)]
    df = spark.createDataFrame(rows, "date int, asset int, x double, y double, fwd_return double")
    found = evaluate.rank_ic(df, ["x", "y"])
    assert "Window" not in plan(found)
    for r in found.collect():
        own = [(x, f) if r["factor"] == "x" else (y, f) for d, _, x, y, f in rows if d == r["date"]]
        a, b = (evaluate.average_ranks(np.array(c)) for c in zip(*own, strict=True))
        assert abs(r["ic"] - np.corrcoef(a, b)[0, 1]) < 1e-9


def test_ranks_have_ties_at_their_average_and_nan_last():
    assert evaluate.average_ranks(np.array([3.0, np.nan, 1.0, 3.0, np.nan])).tolist() == [2.5, 4.5, 1.0, 2.5, 4.5]


def test_long_windows_go_through_one_pass_and_constants_are_undefined():
    assert rolled.in_order("ts_corr", (230,)) and not rolled.in_order("ts_corr", (rolled.LONG - 1,)) and not rolled.in_order("ts_mean", (20, 10))
    place = np.arange(1, 31)
    x, y = np.full(30, 0.1), np.arange(30.0)
    assert np.isnan(rolled.windowed(x, place, "ts_corr", 20, others=y)).all()
    assert rolled.windowed(x, place, "ts_std", 20)[19:].tolist() == [0.0] * 11
    assert rolled.windowed(3 * y, place, "ts_corr", 20, others=y)[19:].tolist() == [1.0] * 11


def test_all_assets_are_exported_without_an_expression_for_each(spark):
    rows = [(d, a, None if d == a else float(10 * d + a)) for d in (3, 1, 2) for a in range(4) if a != 1 or d > 1] + [(5, None, 1.0)]
    found = sources.wide(spark.createDataFrame(rows, "date int, asset int, x double"), "x")
    assert "pivot" not in plan(found) and found.columns == ["date", "0", "1", "2", "3"]
    assert [tuple(r) for r in found.collect()] == [(1, 10, None, 12, 13), (2, 20, 21, None, 23), (3, 30, 31, 32, None), (5, None, None, None, None)]


def test_a_decomposition_makes_the_universe_once(spark, monkeypatch):
    made, styled = [], queries.styled

    def counted(*a):
        made.append(a)
        return styled(*a)

    monkeypatch.setattr(queries, "styled", counted)
    stored, store = [], queries.Tables.store
    monkeypatch.setattr(queries.Tables, "store", lambda self, df, *a: stored.append(df) or store(self, df, *a))
    factors, found = queries.decomposed(spark, str(DATA / "sf0.01"), queries.RISK)
    assert len(made) == 1 and len(stored) == 3 and set(found["share"]) == set(factors)
