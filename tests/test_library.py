"""The factor library: names, layers, order and the gate."""

from __future__ import annotations

import pytest
from conftest import DATA

from factorloom.operators import evaluate
from factorloom.plans import library
from factorloom.plans.graph import compile_factors
from factorloom.sources import panel as sources


def test_layers_have_their_names():
    made = library.library()
    counts = {p: sum(n.startswith(p) for n in made) for p in ("alpha", "a158_", "a360_", "op_", "cross_")}
    assert counts == {"alpha": 40, "a158_": 187, "a360_": 367, "op_": 63, "cross_": 70} and len(made) == sum(counts.values())
    assert "cross_close_X_volume_mul" in made and "op_close_tsrank_5" in made and "a158_open" in made
    with pytest.raises(ValueError):
        library.library(["no such"])


def test_strong_factors_stay_in_order(spark):
    panel = sources.forward_returns(sources.weekly_panel(spark, str(DATA / "sf0.01")))
    made = library.library(["crossed"])
    found = library.build_library(panel, ["crossed"], threshold=0.05, most=10)
    whole = compile_factors(panel, made)
    strong = {r["factor"] for r in evaluate.gate_by_first_dates(whole, list(made), threshold=0.05).collect()}
    assert list(found) == [n for n in made if n in strong][:10] and found


def test_bounds_of_dates_change_nothing(spark):
    """Expressions over part of the dates equal those over all, with gaps, nested windows and dates, and looks ahead."""
    import random

    from factorloom.plans.graph import call, compile_between, field, reaches, walk

    rng = random.Random(5)
    rows = [(a, d, rng.random(), rng.choice([None, rng.random()])) for a in range(9) for d in range(60) if rng.random() < (0.9 if a % 3 else 0.3)]
    df = spark.createDataFrame(rows, "asset int, date int, close double, volume double").cache()
    c, v = field("close"), field("volume")
    made = {
        "row": c + v,
        "mean": call("ts_mean", c, n=(7,)),
        "deep": call("ts_mean", call("cs_rank", call("ts_rank", c, n=(5,))), n=(4,)),
        "ahead": call("ts_delay", c, n=(-2,)),
        "both": call("cs_zscore", call("ts_delta", call("cs_rank", call("ts_delay", c, n=(-1,))), n=(3,))),
        "all": call("loose_decay", c, n=(4,)),
    }
    found = {n: reaches(walk([x]))[x] for n, x in made.items()}
    assert found["row"] == ((0, 0),) and found["mean"] == ((6, 0),) and found["deep"] == ((3, 0), (4, 0)) and found["ahead"] == ((0, 2),)
    assert found["both"] == ((0, 0), (3, 0), (0, 1)) and found["all"][0][0] == float("inf")
    whole = compile_factors(df, made).cache()
    for name, x in made.items():
        for low, high in ((30, 40), (None, 12), (50, None), (70, 80)):
            got = compile_between(df, {name: x}, low, high).select("asset", "date", name)
            want = whole.select("asset", "date", name).filter((whole.date >= (low or -1)) & (whole.date <= (high or 99)))
            key = lambda r: (r["asset"], r["date"])
            a, b = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
            assert [key(r) for r in a] == [key(r) for r in b]
            assert [r[name] for r in a] == [pytest.approx(r[name]) if r[name] is not None else None for r in b], (name, low, high)


def test_gate_reads_its_dates_only(spark):
    """From bars without returns the gate finds what it finds from the whole panel, and its bound reaches the scan."""
    import io
    from contextlib import redirect_stdout

    from factorloom.plans.graph import compile_between

    folder = str(DATA / "sf0.01")
    whole = sources.forward_returns(sources.weekly_panel(spark, folder))
    bars = sources.weekly_panel(spark, folder, returns=False)
    some = dict(list(library.library(["alphas"]).items())[:4]) | dict(list(library.library(["technical"]).items())[:6])
    rows = lambda df: sorted((r["factor"], r["n_dates"], round(r["ic_mean"], 9)) for r in df.collect())
    one = rows(library.gate(bars, some, at_once=3))
    made = compile_factors(whole, some)
    assert one and one == rows(library.gate(whole, some)) == rows(evaluate.gate_by_first_dates(made, list(some), threshold=0.02))
    last = whole.select("date").distinct().orderBy("date").limit(100).agg({"date": "max"}).first()[0]
    out = io.StringIO()
    with redirect_stdout(out):
        compile_between(bars, {"_forward": library.DERIVED["fwd_return"]}, None, last).explain("formatted")
    below = out.getvalue().split("(1) Scan parquet")[-1].split(") Exchange")[0]  # what is done before the first shuffle
    assert "Filter" in below and "next_day" in below and str(last.year) in below
    assert library.gate(bars, {}).collect() == []


def test_common_parts_are_one_table(spark):
    from factorloom.plans.graph import call, field, shared_nodes

    mean = call("ts_mean", field("close"), n=(5,))
    inner = call("ts_std", mean, n=(3,))
    assert shared_nodes([[mean + 1], [mean - 1], [field("close")]]) == [mean]
    assert shared_nodes([[inner], [inner * 2]]) == [inner]  # what only stands inside it needs no column
    assert set(shared_nodes([[inner], [inner * 2], [mean]])) == {inner, mean}
