"""Redundancy of many factors against ranks and correlations taken pair by pair."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from factorloom.operators import evaluate


def test_many_factors(spark):
    rng = np.random.default_rng(3)
    names = [f"f{k}" for k in range(120)]
    days = []
    for d in range(4):
        x = rng.normal(size=(9 if d == 3 else 30, len(names)))
        x[:, 1] = x[:, 0] + 0.1 * rng.normal(size=len(x))
        x[rng.random(x.shape) < 0.2] = np.nan
        x[:, 2], x[:, 3] = 1.0, np.round(x[:, 3])
        x[4:, 4] = np.nan
        days.append(pd.DataFrame(x, columns=names).assign(date=d, asset=range(len(x))))
    table = pd.concat(days)
    df = spark.createDataFrame(table.astype(object).where(table.notna(), None), "struct<" + ",".join(f"{n}:double" for n in names) + ",date:int,asset:int>")
    got = {(r["a"], r["b"]): (r["n_dates"], r["correlation"]) for r in evaluate.redundancy(df, names).collect()}
    assert len(got) == 120 * 119 // 2
    for a, b in [("f0", "f1"), ("f5", "f90"), ("f0", "f2"), ("f3", "f7"), ("f4", "f6"), ("f118", "f119")]:
        found = []
        for d in days[:3]:
            if d[a].count() < 5 or d[b].count() < 5:
                continue
            ranks = pd.DataFrame({"a": d[a].rank(), "b": d[b].rank()}).dropna()
            if len(ranks) >= 5 and ranks["a"].std() > 0 and ranks["b"].std() > 0:
                found.append(np.corrcoef(ranks["a"], ranks["b"])[0, 1])
        assert got[a, b][0] == len(found)
        assert got[a, b][1] is None if not found else got[a, b][1] == pytest.approx(np.mean(found))
