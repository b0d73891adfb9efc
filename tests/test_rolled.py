"""Rolling operators of one pass against plain windows, over batches of any size."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from factorloom.functions.columns import Frame
from factorloom.functions.rolled import Fading, Roll, Series, rolled

NUMBERS = {"ts_rank": (5,), "ts_argmax": (4,), "ts_argmin": (7,), "ts_quantile": (5, 0.8), "ts_decay_linear": (6,), "loose_decay": (6,)}


def plain(values, op, n, *numbers):
    out = []
    for k in range(len(values)):
        window = values[k - n + 1 : k + 1] if k + 1 >= n else []
        whole = [x for x in window if x is not None]
        if op == "loose_decay":
            half, past = max(1, n // 2), values[: k + 1]
            known = [(x, 0.5 ** ((k - i) / half)) for i, x in enumerate(past) if x is not None]
            out.append(sum(x * g for x, g in known) / sum(g for _, g in known) if len(known) >= half else None)
        elif len(whole) < n:
            out.append(None)
        elif op == "ts_rank":
            out.append((sum(x < whole[-1] for x in whole) + (sum(x == whole[-1] for x in whole) + 1) / 2) / n)
        elif op == "ts_argmax":
            out.append(float(whole.index(max(whole))))
        elif op == "ts_argmin":
            out.append(float(whole.index(min(whole))))
        elif op == "ts_quantile":
            out.append(sorted(whole)[int((n - 1) * numbers[0] + 0.5)])
        else:
            out.append(sum(x * (i + 1) for i, x in enumerate(whole)) / (n * (n + 1) / 2))
    return out


def series(seed, count=5):
    rng = random.Random(seed)
    return {a: [rng.choice([None, float("nan"), *([1.0, 2.5, -3.0, rng.random()] * 4)]) for _ in range(rng.randrange(1, 90))] for a in range(count)}


def same(got, want):
    return len(got) == len(want) and all((a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-14)) for a, b in zip(got, want, strict=True))


def clean(values):
    return [None if x is None or math.isnan(x) else x for x in values]


@pytest.mark.parametrize("size", [1, 3, 50, 1000])
def test_same_for_batches_of_any_size(size):
    made = series(size)
    values = np.array([math.nan if x is None else x for v in made.values() for x in v])
    place = np.array([k + 1 for v in made.values() for k in range(len(v))])
    rolls = [Roll(op, "x", n, op) for op, n in NUMBERS.items()]
    own, found = Series(rolls), []
    for at in range(0, len(values), size):
        found.append(own.go_on({"x": values[at : at + size]}, place[at : at + size]))
    for k, r in enumerate(rolls):
        got = clean(np.concatenate([f[k] for f in found]).tolist())
        assert same(got, [y for v in made.values() for y in plain(clean(v), r.op, *r.numbers)]), r.op


def test_rows_out_of_order_are_an_error():
    with pytest.raises(RuntimeError):
        Series([Roll("ts_rank", "x", (2,), "y")]).go_on({"x": np.zeros(3)}, np.array([1, 3, 2]))


def test_scaled_sums_stay_exact_over_long_series():
    rng = np.random.default_rng(1)
    x = rng.standard_normal(5000) * 10.0 ** rng.integers(-3, 4, 5000)
    want, s, g = [], 0.0, 0.0
    for v in x:
        s, g = s / 2**0.5 + v, g / 2**0.5 + 1
        want.append(s / g)
    np.testing.assert_allclose(Fading(4).go_on(x)[1:], want[1:], rtol=1e-9, atol=1e-9)


def test_columns_of_a_panel(spark):
    made = series(9, 12)
    rows = [(a, k, x, "kept") for a, v in made.items() for k, x in enumerate(v)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "asset int, date int, x double, _place string").repartition(3)
    got = rolled(df, [Roll(op, "x", n, op) for op, n in NUMBERS.items()], Frame())
    assert got.columns == ["asset", "date", "x", "_place", *NUMBERS] and rolled(df.limit(0), [Roll("ts_rank", "x", (3,), "y")], Frame()).collect() == []
    table = sorted(got.collect(), key=lambda r: (r["asset"], r["date"]))
    for op, n in NUMBERS.items():
        assert same([r[op] for r in table], [y for a in sorted(made) for y in plain(clean(made[a]), op, *n)]), op
