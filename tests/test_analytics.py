"""Analytics against pandas and NumPy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from test_expressions import panel

from factorloom.miner import search
from factorloom.models import ensemble, rolling
from factorloom.models.base import ElasticNetModel, RidgeModel
from factorloom.operators import backtest, combine, costs, evaluate, risk, style
from factorloom.plans.text import parse
from factorloom.sources import universe as universes
from factorloom.sources.panel import forward_returns
from factorloom.streaming.bars import daily_bars


@pytest.fixture(scope="module")
def rows(spark):
    made = forward_returns(panel(spark, 40, 90))
    return made.withColumns({"f": -F.col("returns"), "g": F.col("volume"), "h": F.col("volume") + 0.1 * F.col("close")}).cache()


def test_rank_ic_is_spearman(rows):
    got = evaluate.rank_ic(rows, ["f", "g"], pairwise=True).toPandas().set_index(["date", "factor"])["ic"]
    table = rows.toPandas()
    for f in ("f", "g"):
        for date, day in table.dropna(subset=[f, "fwd_return"]).groupby("date"):
            want = day[f].rank().corr(day["fwd_return"].rank())
            assert got[date, f] == pytest.approx(want, abs=1e-9)


def test_selection(rows):
    assert evaluate.filter_by_ic(rows, ["f", "g"], threshold=0.0) == ["f", "g"]
    assert evaluate.filter_by_ic(rows, ["f", "g"], threshold=1.1) == []
    assert len(evaluate.remove_redundant(rows, ["g", "h", "f"], threshold=0.7)) == 2
    assert evaluate.remove_redundant(rows, ["g", "h", "f"], threshold=0.7, by_ic=False) == ["g", "f"]
    assert evaluate.remove_redundant(rows, ["f"]) == ["f"]


def test_pooled_spearman(rows):
    table = rows.toPandas().dropna(subset=["f", "fwd_return"])
    assert evaluate.spearman(rows, "f", "fwd_return") == pytest.approx(table["f"].rank().corr(table["fwd_return"].rank()), abs=1e-9)
    assert evaluate.spearman(rows.limit(3), "f", "fwd_return") is None


def test_groups_are_those_of_equal_widths(rows):
    got = backtest.grouped(rows, ["f"], groups=5).toPandas()
    table = rows.toPandas().dropna(subset=["f", "fwd_return"])
    table["n"] = table.groupby("date")["f"].transform("count")
    table = table[table["n"] >= 25].copy()
    table["want"] = table.groupby("date")["f"].transform(lambda s: pd.cut(s.rank(pct=True), 5, labels=False) + 1)
    both = got.merge(table, on=["date", "asset"])
    assert len(both) == len(got) == len(table) and (both["grp"] == both["want"]).all()


def test_turnover_and_costs(spark, rows):
    old = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "asset string, weight double")
    new = spark.createDataFrame([("b", 0.5), ("c", 0.5)], "asset string, weight double")
    r = costs.turnover(old, new, 1e8).first()
    assert (r["turnover"], r["buys"], r["sells"]) == (0.5, 5e7, 5e7)
    each = 5e7 * (0.0003 + 0.1 * 0.5**0.5)
    assert r["cost"] == pytest.approx(2 * each + 5e7 * 0.0005)
    got = costs.group_turnover(rows, ["f"]).toPandas()
    marked = backtest.grouped(rows, ["f"], None).toPandas()  # whether or not a return follows
    dates = sorted(marked["date"].unique())
    for a, b in list(zip(dates, dates[1:]))[:5]:
        one, two = (marked[(marked["date"] == d) & (marked["grp"] == 5)].set_index("asset")["factor"] for d in (a, b))
        w = [pd.Series(1 / max(1, len(x)), index=x.index) for x in (one, two)]
        want = w[1].sub(w[0], fill_value=0).abs().sum() / 2
        assert got[(got["date"] == b) & (got["grp"] == 5)]["turnover"].iloc[0] == pytest.approx(want)
        held = []
        for d in (a, b):  # the highest group less the lowest
            day = marked[marked["date"] == d].set_index("asset")["grp"]
            held.append((day == 5) / (day == 5).sum() - (day == 1) / (day == 1).sum())
        want = held[1].astype(float).sub(held[0].astype(float), fill_value=0).abs().sum() / 2
        assert got[(got["date"] == b) & (got["grp"] == 0)]["turnover"].iloc[0] == pytest.approx(want)


def test_weights_have_size_one(rows):
    ics = combine.rolling_ic(rows, ["f", "g"], min_obs=10)
    for method in ("ic", "icir", "max_icir"):
        w = combine.ic_weights(ics, ["f", "g"], method).toPandas()
        np.testing.assert_allclose(w.groupby("date")["weight"].apply(lambda s: s.abs().sum()), 1, atol=1e-9)
    with pytest.raises(ValueError):
        combine.ic_weights(ics, ["f"], "no")


def test_linear_models_are_their_closed_forms(rows):
    names = ["f", "g", "close"]
    table = rows.toPandas().dropna(subset=[*names, "fwd_return"])
    x, y = table[names].to_numpy(float), table["fwd_return"].to_numpy(float)
    got = RidgeModel(names, alpha=50.0).fit(rows).predict(rows).toPandas().set_index(["asset", "date"])["prediction"]
    got = got.loc[pd.MultiIndex.from_frame(table[["asset", "date"]])].to_numpy()
    z = (x - x.mean(0)) / x.std(0)  # standardised by the deviation of the rows at hand, not an estimate of a population's
    w = np.linalg.solve(z.T @ z + 50.0 * np.eye(3), z.T @ (y - y.mean()))
    np.testing.assert_allclose(got, y.mean() + z @ w, atol=1e-9)
    m = ElasticNetModel(names, alpha=1e-4, l1_ratio=0.5).fit(rows)
    z, w = (x - x.mean(0)) / x.std(0), np.zeros(3)
    for _ in range(2000):
        for j in range(3):
            r = y - y.mean() - z @ w + z[:, j] * w[j]
            c = z[:, j] @ r / len(y)
            w[j] = np.sign(c) * max(abs(c) - 1e-4 * 0.5, 0) / (z[:, j] @ z[:, j] / len(y) + 1e-4 * 0.5)
    np.testing.assert_allclose(m.standardised, w, atol=1e-8)
    assert sum(m.importance().values()) == pytest.approx(1)


def test_ensembles_registry_and_splits(rows):
    assert rolling.splits(300) == [(0, 156, 208, 260), (20, 176, 228, 280), (40, 196, 248, 300)]
    assert rolling.splits(100, 2) == [(0, 60, 80, 100)]
    assert len(rolling.choose_features([f"x{k}" for k in range(9)], 4)) == 4
    with pytest.raises(ValueError):
        ensemble.get_model("no", ["f"])
    makers = [lambda: ensemble.get_model("ridge", ["f", "g"]), lambda: ensemble.get_model("boosted", ["f", "g"], rounds=2)]
    mix = ensemble.BlendingEnsemble(makers).fit(rows, rows)
    assert sum(mix.weights) == pytest.approx(1)
    assert ensemble.BlendingEnsemble(makers, [1, 3]).fit(rows).weights == [0.25, 0.75]
    assert "prediction" in mix.predict(rows).columns
    with pytest.raises(RuntimeError):
        ensemble.get_model("ridge", ["f"]).predict(rows)


def test_risk_model(spark):
    universe = style.add_styles(universes.synthetic_universe(spark, 120, "2020-01-03", "2022-06-30"), ["size", "value"], neutralize=False).cache()
    model = risk.RiskModel(("size", "value"), lookback=60)
    table = risk.returns_table(risk.factor_returns(universe, model))
    assert 0 < len(table) <= 59
    cov = risk.factor_covariance(table, model)
    np.testing.assert_allclose(cov, cov.T, atol=1e-12)
    assert np.linalg.eigvalsh(cov).min() > -1e-10
    pairs = risk.lagged_pairs(universe, model).toPandas()
    day = pairs[pairs["date"] == table.index[-1]]
    x, names, dummies = risk._design(day, model)
    f = table.iloc[-1][names].to_numpy()
    cap = day["market_cap"].to_numpy()
    assert abs((cap @ dummies) @ f[-dummies.shape[1] :]) / cap.sum() < 1e-9
    w = np.sqrt(cap) / np.sqrt(cap).sum()
    gap = x.T @ (w * (day["returns"].to_numpy() - x @ f))
    np.testing.assert_allclose(gap[:3], 0, atol=1e-9)
    weights = risk.pure_portfolio(universe, model, "size").toPandas()
    last = weights[weights["date"] == weights["date"].max()]
    assert last["weight"].abs().sum() == pytest.approx(2)
    specific = risk.specific_risk(universe, risk.factor_returns(universe, model), model)
    date = last["date"].iloc[0]
    found = risk.decompose(universe, spark.createDataFrame(last[["asset", "weight"]]), cov, specific, model, date)
    assert found["factor_variance"] + found["specific_variance"] == pytest.approx(found["total_risk"] ** 2)
    assert abs(found["exposure"]["value"]) < 1e-6 < abs(found["exposure"]["size"])


def test_covariance_parts():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 3)) * [0.01, 0.02, 0.03]
    w = risk.exponential_weights(60, 26)
    assert w.sum() == pytest.approx(1) and w[-1] / w[-27] == pytest.approx(2)
    np.testing.assert_allclose(risk.newey_west(x, w, 0), (x * w[:, None]).T @ x)
    np.testing.assert_allclose(risk.eigen_adjusted(np.eye(3), 5, 100, 1), np.eye(3))


def sampling_bias(cov, n_dates, simulations, seed):
    """Eigenvalues of samples in full coordinates over the true ones, largest first."""
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)
    values, vectors = values[order], vectors[:, order]
    rng, ratios = np.random.default_rng(seed), []
    for _ in range(simulations):
        rows = []
        for z in rng.standard_normal((n_dates, len(cov))):
            rows.append(vectors @ (np.sqrt(values) * z))
        rows = np.array(rows) - np.mean(rows, axis=0)
        ratios.append(np.sqrt(np.sort(np.linalg.eigvalsh(rows.T @ rows / (n_dates - 1)))[::-1] / values))
    return values, vectors, np.mean(ratios, axis=0)


def test_eigenvalues_are_corrected_by_their_sampling_bias():
    rng = np.random.default_rng(8)
    spread = rng.standard_normal((10, 10))
    cov = spread @ np.diag(0.1 * 1.7 ** np.arange(10)) @ spread.T
    values, vectors, bias = sampling_bias(cov, 52, 40, 42)
    np.testing.assert_allclose(risk.eigenvalue_bias(values, 52, 40, 42), bias, rtol=1e-12)
    want = sum(v * (1.2 / max(b, 0.1)) ** 2 * np.outer(x, x) for v, b, x in zip(values, bias, vectors.T, strict=True))
    np.testing.assert_allclose(risk.eigen_adjusted(cov, 52, 40, 42), want, rtol=0, atol=1e-12 * np.abs(want).max())
    # samples spread eigenvalues, so the correction draws them together
    assert bias[0] > 1 > bias[-1]
    np.testing.assert_allclose(risk.eigen_adjusted(cov, 14, 40, 42), cov, atol=1e-12 * np.abs(cov).max())


def test_covariance_and_decomposition_with_simulations(spark):
    """The whole covariance from plain loops over dates, and a portfolio's decomposition by it."""
    import pandas as pd

    model = risk.RiskModel(styles=("size", "value"), lookback=30)
    assert model.simulations == 100
    rng = np.random.default_rng(3)
    names = ["country", "industry:a", "size", "value"]
    table = pd.DataFrame(rng.standard_normal((29, 4)) * [0.02, 0.01, 0.005, 0.001] + 0.002, columns=names)
    x = table.to_numpy()
    w = np.array([0.5 ** ((28 - t) / 52) for t in range(29)])
    w = w / w.sum()
    mean = sum(w[t] * x[t] for t in range(29))
    y = x - mean
    cov = sum(w[t] * np.outer(y[t], y[t]) for t in range(29))
    for lag in (1, 2):
        part = sum(w[t] * np.outer(y[t], y[t - lag]) for t in range(lag, 29))
        cov = cov + (1 - lag / 3) * (part + part.T)
    values, vectors, bias = sampling_bias(cov, 29, 100, 42)
    cov = (vectors * (values * (1.2 / np.maximum(bias, 0.1)) ** 2)) @ vectors.T
    recent = np.array([0.5 ** ((28 - t) / 26) for t in range(29)])
    cov = cov * sum(r * np.mean(x[t] ** 2 / np.diag(cov)) for t, r in enumerate(recent / recent.sum()))
    got = risk.factor_covariance(table, model)
    np.testing.assert_allclose(got.to_numpy(), cov, rtol=0, atol=1e-12 * np.abs(cov).max())
    rows = [(1, f"s{k}", "a", 10.0 + k, 0.01, float(k), 1.0 - k) for k in range(6)]
    universe = spark.createDataFrame(rows, "date int, asset string, industry string, market_cap double, returns double, size double, value double")
    held = spark.createDataFrame([(f"s{k}", (-1.0) ** k * (k + 1) / 7) for k in range(6)], "asset string, weight double")
    specific = spark.createDataFrame([(f"s{k}", 0.1 + k / 100) for k in range(6)], "asset string, risk double")
    found = risk.decompose(universe, held, got, specific, model, 1)
    h = np.array([(-1.0) ** k * (k + 1) / 7 for k in range(6)])
    own = np.array([h.sum(), h.sum(), h @ np.arange(6.0), h @ (1.0 - np.arange(6.0))])
    alone = float(((h * (0.1 + np.arange(6) / 100)) ** 2).sum())
    assert found["factor_variance"] == pytest.approx(own @ cov @ own, rel=1e-9)
    assert found["specific_variance"] == pytest.approx(alone) and found["total_risk"] ** 2 == pytest.approx(own @ cov @ own + alone)
    for k, n in enumerate(names):
        assert found["share"][n] == pytest.approx(own[k] * (cov @ own)[k] / (own @ cov @ own + alone), rel=1e-8)


def test_miner_finds_what_is_planted(spark):
    rows = panel(spark, 30, 40, gaps=0.0)
    planted = rows.withColumn("fwd_return", F.col("high") / F.col("low") - 1)
    p = search.Parameters(population=12, generations=2, threshold=0.3, min_obs=5, min_rows=50, checked=5)
    runs = [search.mine_factors(planted, parameters=p) for _ in range(2)]
    assert [f.text for f in runs[0]] == [f.text for f in runs[1]]
    assert all(abs(f.ic) >= 0.3 for f in runs[0])
    miner = search.Miner(planted, parameters=p)
    best = parse("high / low - 1")
    miner.judge([best, parse("1 + 2")])
    assert miner.fitness(best) == pytest.approx(1) and miner.fitness(parse("1 + 2")) == -1
    assert miner.redundant(parse("(high - low) / low"), [search.Found(best, 1.0, 1.0)])
    assert search.pool_table(planted, []).columns == ["expression", "ic", "icir", "depth", "size"]


def test_stored_values_change_nothing(spark):
    """The same pool with a store, with one that holds two nodes, and without; what is stored is what the expressions take."""
    from dataclasses import replace

    rows = panel(spark, 30, 40, gaps=0.0).withColumn("fwd_return", F.col("high") / F.col("low") - 1)
    p = search.Parameters(population=10, generations=2, threshold=0.02, min_obs=5, min_rows=50, checked=4)
    n = rows.count()
    pools = [[(f.text, round(f.ic, 9)) for f in search.mine_factors(rows, parameters=replace(p, stored_bytes=b))] for b in (1 << 31, 16 * n, 0)]
    assert pools[0] == pools[1] == pools[2] and pools[0]
    values = search.Values(rows, 16 * n)
    mean, std = parse("ts_mean(close, 5)"), parse("ts_std(close, 5)")
    values.prepare([mean + 1, mean - 1, std + 1, std - 1])
    assert set(values.names) == {mean, std} and values.room == 2
    top = parse("ts_max(high, 5)")
    values.prepare([mean + 2, mean * 2])
    values.prepare([top + 1, top - 1])
    assert set(values.names) == {mean, top}  # what wasn't used for longest went
    assert [x.op for x in values.by_columns([mean + 1])[0].args] == ["field", "const"]
    values.tables.drop()


def test_universe_sources(spark, tmp_path):
    u = universes.synthetic_universe(spark, 5, "2020-01-03", "2021-12-31")
    a, b = u.orderBy("asset", "date").collect(), u.repartition(7).orderBy("asset", "date").collect()
    assert a == b and len(a) == 5 * 105
    p = universes.ohlcv_from_returns(u).toPandas()
    assert (p["high"] >= p["close"]).all() and (p["low"] <= p["close"]).all()
    one = p[p["asset"] == "000001"].sort_values("date")
    want = (1 + one["returns"].where(np.arange(len(one)) > 0, 0)).cumprod()
    np.testing.assert_allclose(one["close"], want)
    (tmp_path / "bars.csv").write_text("code,day,open,high,low,close,volume\nx,2020-01-02,1,2,1,oops,3\nx,2020-01-03,1,2,1,2,3\n")
    read = universes.read_daily_bars(spark, str(tmp_path / "bars.csv"), "csv", {"asset": "code", "date": "day"})
    assert [r["close"] for r in read.orderBy("date").collect()] == [None, 2.0]
    assert universes.universe_from_bars(read, 1).count() == 1


def test_streamed_bars(spark, tmp_path):
    rows = [(1, f"2024-01-0{d} 0{h}:00:00", 10 * d + h, float(h)) for d in range(1, 5) for h in range(3)]
    events = spark.createDataFrame(rows, "user_id long, ts string, event_id long, value double").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "in"))
    stream = daily_bars(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("bars").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("bars").orderBy("date").collect()
    assert len(got) == 4 and (got[0]["open"], got[0]["close"], got[0]["volume"]) == (0.0, 2.0, 3.0)


def test_search_survives_expressions_that_fail(spark, monkeypatch):
    miner = search.Miner(forward_returns(panel(spark, 40, 90)), parameters=search.Parameters(min_obs=3, min_dates=1))
    good, bad = parse("close - open"), parse("high - low")
    whole = search.Miner._ics

    def fails(self, trees, coarse):
        if bad in trees:
            raise AnalysisException("no such thing")
        return whole(self, trees, coarse)

    monkeypatch.setattr(search.Miner, "_ics", fails)
    found = miner.ics([good, bad], False)
    assert good in found and bad not in found


def test_pooled_matrix(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4)) + 1e6
    x[:, 1] = x[:, 0] + rng.normal(size=500)
    x[:, 3] = 5.0
    rows = [tuple(None if rng.random() < 0.1 else float(v) for v in r) for r in x]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(3)
    got = evaluate.pooled_matrix(df, ["a", "b", "c", "d"])
    table = df.toPandas()
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    for (p, q), c in got.items():
        assert abs(c - table[p].corr(table[q])) < 1e-6
