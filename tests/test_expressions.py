"""Expressions: the text language, the graph, and invariants of what they compute."""

from __future__ import annotations

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.operators import alphas, expand, lagged, style, technical
from factorloom.plans import text
from factorloom.plans.graph import call, compile_factors, field, node
from factorloom.sources.panel import complete


def panel(spark, n_assets=12, n_dates=80, seed=3, gaps=0.1):
    rng = random.Random(seed)
    rows = []
    for a in range(n_assets):
        price = 10.0 + a
        for d in range(n_dates):
            price *= 1 + rng.gauss(0, 0.03)
            if rng.random() < gaps:
                continue
            high, low = price * (1 + abs(rng.gauss(0, 0.01))), price * (1 - abs(rng.gauss(0, 0.01)))
            rows.append((a, datetime.date(2020, 1, 3) + datetime.timedelta(7 * d), price * 0.99, high, low, price, rng.uniform(1, 9), a % 3))
    return complete(spark.createDataFrame(rows, "asset int, date date, open double, high double, low double, close double, volume double, industry int"))


@pytest.mark.parametrize("template", text.TEMPLATES)
def test_text_parses_to_itself(template):
    tree = text.parse(template)
    assert text.parse(text.to_text(tree)) == tree


@pytest.mark.parametrize(
    ("one", "other"),
    [
        ("close -1", "close - 1"),
        ("close - 2 * -volume", "sub(close, mul(2, neg(volume)))"),
        ("add(close, 2)", "close + 2"),
        ("ts_mean(close)", "ts_mean(close, 10)"),
        ("ts_corr(open)", "ts_corr(open, volume, 10)"),
        ("ts_rank()", "ts_rank(close, 10)"),
        ("-(3)", "-3"),
        ("1 - 2 - 3", "(1 - 2) - 3"),
    ],
)
def test_grammar(one, other):
    assert text.parse(one) == text.parse(other)


@pytest.mark.parametrize("bad", ["", "close close", "foo(close)", "ts_mean(close", "(close", "close +", "ts_mean(close, 0)", "abs(close, open)", "close $"])
def test_bad_text(bad):
    with pytest.raises(text.ParseError):
        text.parse(bad)


def test_equal_expressions_are_one_node():
    assert call("cs_rank", call("cs_rank", field("close"))) == call("cs_rank", field("close"))
    assert len({alphas.ADV20, call("ts_mean", field("volume"), n=(20,))}) == 1
    assert (field("a") + 1).depth() == 2 and (field("a") + 1).size() == 3


def test_deep_alphas_are_a_few_stages(spark):
    plan = compile_factors(panel(spark), {k: alphas.ALPHAS[k] for k in ("alpha029", "alpha031")})
    text_ = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text_.count("Window [") < 30


def test_rolling_operators_are_those_of_pandas(spark):
    rows = panel(spark)
    c, v = field("close"), field("volume")
    made = {
        "mean": call("ts_mean", c, n=(5,)),
        "std": call("ts_std", c, n=(5,)),
        "rank": call("ts_rank", c, n=(5,)),
        "corr": call("ts_corr", c, v, n=(5,)),
        "decay": call("ts_decay_linear", c, n=(5,)),
        "ewm": call("loose_decay", c, n=(10,)),
        "loose": call("ts_mean", c, n=(10, 5)),
        "cs": call("cs_rank", c),
    }
    got = compile_factors(rows, made).toPandas().sort_values(["asset", "date"]).reset_index(drop=True)
    g = got.groupby("asset")["close"]
    weights = np.arange(1, 6) / 15
    want = {
        "mean": g.transform(lambda s: s.rolling(5).mean()),
        "std": g.transform(lambda s: s.rolling(5).std()),
        "rank": g.transform(lambda s: s.rolling(5).rank() / 5),
        "corr": got.groupby("asset", group_keys=False)[["close", "volume"]].apply(lambda d: d["close"].rolling(5).corr(d["volume"])),
        "decay": g.transform(lambda s: s.rolling(5).apply(lambda w: float(w @ weights), raw=True)),
        "ewm": g.transform(lambda s: s.ewm(halflife=5, min_periods=5).mean()),
        "loose": g.transform(lambda s: s.rolling(10, min_periods=5).mean()),
        "cs": got.groupby("date")["close"].rank(pct=True),
    }
    for k, x in want.items():
        np.testing.assert_allclose(got[k].to_numpy(float), x.to_numpy(float), atol=1e-8, err_msg=k)


def test_operators_look_back_only(spark):
    rows = panel(spark)
    cut = datetime.date(2020, 12, 1)
    names = ["alpha026", "alpha035", "alpha043"]
    whole = alphas.add_alphas(rows, names).filter(F.col("date") <= F.lit(cut)).select("asset", "date", *names)
    early = alphas.add_alphas(rows.filter(F.col("date") <= F.lit(cut)), names).select("asset", "date", *names)
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted(map(tuple, early.collect()), key=repr)


def test_names_are_the_columns(spark):
    rows = panel(spark, 3, 10)
    assert len(technical.technical_names()) == 180 and len(lagged.lagged_names()) == 360 and len(alphas.ALPHAS) == 40
    families = ["KMID", "SUMP"]
    assert technical.add_technical(rows, families, (5,)).columns == [*rows.columns, "KMID5", "SUMP5"]
    assert lagged.add_lagged(rows, 3, ("VOL",)).columns[-3:] == ["VOL_D0", "VOL_D1", "VOL_D2"]
    assert expand.expand_factors(rows, ["close"], (5,), ["tsmax"]).columns[-1] == "close_tsmax_5"
    assert expand.cross_all(rows, ["close", "open"]).columns[-3:] == [f"close_X_open_{o}" for o in ("mul", "div", "sub")]
    for bad in (lambda: expand.expanded_factors(["close"], operators=["no"]), lambda: expand.crossed_factors(["a", "b"], ["no"])):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        alphas.add_alphas(rows, ["alpha999"])


def test_cross_sections(spark):
    rows = panel(spark, 15, 20, gaps=0.0)
    made = {"rank": call("cs_rank", field("close")), "scale": call("cs_scale", field("returns")), "neutral": call("cs_neutralize", field("returns"), field("industry"))}
    got = compile_factors(rows.withColumn("industry", F.col("industry").cast("double")), made).toPandas()
    assert got["rank"].between(0, 1).all() and (got["rank"] > 0).all()
    sums = got.dropna(subset=["scale"]).groupby("date")["scale"].apply(lambda s: s.abs().sum())
    np.testing.assert_allclose(sums, 1)
    means = got.dropna(subset=["neutral"]).groupby(["date", "industry"])["neutral"].mean()
    np.testing.assert_allclose(means, 0, atol=1e-12)


def test_constants_gaps_and_undefined_numbers(spark):
    day = lambda k: datetime.date(2020, 1, 3) + datetime.timedelta(7 * k)
    rows = [(1, day(k), 5.0, 5.0, 5.0, 5.0, 0.0) for k in range(12)] + [(2, day(0), 1.0, 2.0, 1.0, float("nan"), float("inf"))]
    rows += [(3, day(k), None, None, None, None, None) for k in range(3)]
    df = complete(spark.createDataFrame(rows, "asset int, date date, open double, high double, low double, close double, volume double"))
    got = alphas.add_alphas(df)
    got = technical.add_technical(got, None, (5,)).toPandas()
    assert len(got) == 16
    assert not np.isinf(got.select_dtypes("number").to_numpy(float)).any()
    assert got.loc[got["asset"] == 1, "CORD5"].isna().all()


def test_styles(spark):
    rows = panel(spark, 30, 70, gaps=0.0).withColumns(
        {"market_cap": F.col("close") * 1e6, "book_to_price": 1 / F.col("close"), "roe": F.col("volume") / 100, "volatility": F.col("volume")}
    )
    got = style.add_styles(rows).toPandas()
    for name in style.STYLES:
        by = got.dropna(subset=[name]).groupby("date")[name]
        np.testing.assert_allclose(by.mean(), 0, atol=1e-9)
        np.testing.assert_allclose(by.std(), 1, atol=1e-9)
    assert pd.isna(got.loc[got["date"] == got["date"].min(), "momentum"]).all()
    assert node(2).numbers == (2.0,)
