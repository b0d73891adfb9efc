"""Every query against its SQL on an independent engine, over the smallest tables."""

from __future__ import annotations

import duckdb
import pytest
from conftest import DATA

from factorloom import queries

SF = DATA / "sf0.001"
QUERIES, SQL = queries.queries(), queries.oracle_sql()
#: A cross-section of the smallest tables is too small for a risk model, or has no single solution.
MANY_NAMES = {
    "factor_returns_wls", "factor_cov_plain", "specific_risk", "specific_risk_distribution", "pure_portfolio_last",
    "pure_portfolio_largest", "risk_decomposition_plain", "combine_max_icir", "combine_summary", "library_crosses", "library_gate", "research_top", "backtest_run",
}


def connected(folder):
    con = duckdb.connect()
    for table in ("lineitem", "supplier", "orders", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


@pytest.fixture(scope="module")
def duck():
    return connected(SF)


@pytest.fixture(scope="module")
def larger():
    return connected(DATA / "sf0.01")


def plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(repr(r[i] + 0.0 if isinstance(r[i], float) and r[i] == 0 else r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(MANY_NAMES))
def test_same_as_sql_with_many_names(spark, larger, name):
    df = QUERIES[name](spark, str(DATA / "sf0.01"))
    found = larger.execute(SQL[name])
    names = [d[0] for d in found.description]
    rows = [tuple(r) for r in df.collect()]
    assert rows and sorted(df.columns) == sorted(names)
    assert plain(rows, df.columns) == plain(found.fetchall(), names)


@pytest.mark.parametrize("name", sorted(SQL.keys() - MANY_NAMES))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, str(SF))
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(found.fetchall(), names)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs_without_sql(spark, name):
    folder = SF if name in ("synthetic_universe", "ohlcv_from_returns", "backtest_comparison", "cross_selected") else DATA / "sf0.01"
    df = QUERIES[name](spark, str(folder))
    assert df.columns == QUERIES[name](spark, str(folder)).columns
    df.take(1)
