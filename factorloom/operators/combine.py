"""Combination of factors into one, with weights from their past information coefficients."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.columns import ratio
from factorloom.operators.evaluate import finite, long_factors, rank_ic

WINDOW, HALF_LIFE = 52, 26


def equal_weight(panel: DataFrame, factors: list[str]) -> DataFrame:
    """(date, asset, combined): the sum of the factors over their number, missing ones as 0; NULL if all are missing."""
    known = F.coalesce(*[F.col(f"`{f}`") for f in factors])
    total = sum((F.coalesce(F.col(f"`{f}`"), F.lit(0.0)) for f in factors), F.lit(0.0))
    return panel.select("date", "asset", F.when(known.isNotNull(), total / len(factors)).alias("combined"))


def rolling_ic(panel: DataFrame, factors: list[str], forward: str = "fwd_return", min_obs: int = 30) -> DataFrame:
    """(date, factor, n, ic): pairwise daily ICs, NULL on dates with fewer than ``min_obs`` names."""
    return rank_ic(panel, factors, forward, pairwise=True, min_obs=min_obs, keep_empty=True)


def ic_weights(
    ics: DataFrame,
    factors: list[str],
    method: str = "ic",
    window: int = WINDOW,
    half_life: float = HALF_LIFE,
    lag: int = 0,
    min_ics: int = 10,
) -> DataFrame:
    """(date, factor, weight): of each date weights whose sizes sum to 1, from each factor's last ``window`` known ICs.

    method: ``ic``, the exponentially weighted mean of the ICs, ``icir``, that
    mean over the weighted deviation (0 if that is 1e-8 or less), or
    ``max_icir``. A factor with fewer than ``min_ics`` ICs has 1 over the
    number of factors before sizes are made to sum to 1. The IC of a date takes
    the return after it; ``lag`` leaves the last so many ICs out.
    """
    if method == "max_icir":
        return _max_icir(ics, factors, window, half_life, lag, min_ics)
    decay = 0.5 ** (1 / half_life)
    order = Window.partitionBy("factor").orderBy("date")
    known = ics.filter(finite(F.col("ic"))).select("factor", "date", "ic")
    tail = F.collect_list("ic").over(order.rowsBetween(-(window - 1) - lag, -lag))
    lists = known.select("factor", "date", tail.alias("v"))
    dates = ics.select("date").distinct()
    names = ics.sparkSession.createDataFrame([(f,) for f in factors], "factor string")
    # each date's last list: where a factor has no IC of its own, the one before
    grid = dates.join(F.broadcast(names)).join(lists, ["date", "factor"], "left")
    filled = grid.withColumn("v", F.last("v", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    power = F.transform("v", lambda x, k: F.pow(F.lit(decay), F.size("v") - 1 - k))
    add = lambda column: F.aggregate(column, F.lit(0.0), lambda s, e: s + e)
    rows = filled.withColumn("w", power).withColumn("mean", ratio(add(F.zip_with("v", "w", lambda x, w: x * w)), add(F.col("w"))))
    if method == "icir":
        squares = F.zip_with("v", "w", lambda x, w: w * F.pow(x - F.col("mean"), F.lit(2.0)))
        deviation = F.sqrt(ratio(add(squares), add(F.col("w"))))
        raw = F.when(deviation > 1e-8, F.col("mean") / deviation).otherwise(0.0)
    elif method == "ic":
        raw = F.col("mean")
    else:
        raise ValueError(f"no such method: {method}")
    raw = F.when(F.coalesce(F.size("v"), F.lit(0)) < min_ics, 1.0 / len(factors)).otherwise(raw)
    total = F.sum(F.abs("raw")).over(Window.partitionBy("date"))
    return rows.withColumn("raw", raw).select(
        "date", "factor", F.when(total > 1e-12, F.col("raw") / total).otherwise(1.0 / len(factors)).alias("weight")
    )


def _max_icir(ics: DataFrame, factors: list[str], window: int, half_life: float, lag: int, min_ics: int) -> DataFrame:
    """Weights along the inverse covariance of the ICs times their mean; equal with too few ICs.

    ICs are one number a factor and date, so a window of dates is small: every
    date's window is one group of window times factors numbers.
    """
    order = Window.partitionBy("factor").orderBy("date")
    known = ics.filter(finite(F.col("ic"))).select("factor", "date", "ic")
    tail = F.collect_list("ic").over(order.rowsBetween(-(window - 1) - lag, -lag))
    lists = known.select("factor", "date", tail.alias("v"))
    names = ics.sparkSession.createDataFrame([(f,) for f in factors], "factor string")
    grid = ics.select("date").distinct().join(F.broadcast(names)).join(lists, ["date", "factor"], "left")
    filled = grid.withColumn("v", F.last("v", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))

    def solve(day: pd.DataFrame) -> pd.DataFrame:
        tails = {f: (np.asarray(v, dtype=float) if v is not None else np.zeros(0)) for f, v in zip(day["factor"], day["v"], strict=True)}
        least = min(len(tails.get(f, ())) for f in factors)
        weights = np.full(len(factors), 1 / len(factors))
        if least >= min_ics:
            table = np.array([tails[f][-least:] for f in factors])
            g = 0.5 ** (np.arange(least - 1, -1, -1) / half_life)
            mean = table @ (g / g.sum())
            cov = np.atleast_2d(np.cov(table)) + 1e-6 * np.eye(len(factors))
            found = np.linalg.solve(cov, mean)
            if np.abs(found).sum() > 1e-12:
                weights = found / np.abs(found).sum()
        return pd.DataFrame({"date": day["date"].iloc[0], "factor": factors, "weight": weights})

    kind = ics.schema["date"].dataType.simpleString()
    return filled.groupBy("date").applyInPandas(solve, f"date {kind}, factor string, weight double")


def combine(
    panel: DataFrame,
    factors: list[str],
    method: str = "ic",
    forward: str = "fwd_return",
    window: int = WINDOW,
    min_obs: int = 30,
    lag: int = 0,
    start: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """((date, asset, combined), (date, factor, weight)) for ``equal``, ``ic``, ``icir`` or ``max_icir`` weights.

    Weights start at the panel's date number ``start`` (window + 10, 60 at
    least, unless told); missing factors are 0 in the weighted sum.
    """
    if method == "equal":
        dates = panel.select("date").distinct()
        names = panel.sparkSession.createDataFrame([(f, 1 / len(factors)) for f in factors], "factor string, weight double")
        return equal_weight(panel, factors), dates.join(F.broadcast(names))
    first = max(window + 10, 60) if start is None else start
    ics = rolling_ic(panel, factors, forward, min_obs)
    days = panel.select("date").distinct()  # one row a date: numbering them is small
    days = days.withColumn("_d", F.row_number().over(Window.orderBy("date"))).filter(F.col("_d") > first).select("date")
    weights = ic_weights(ics, factors, method, window, lag=lag).join(F.broadcast(days), "date")
    rows = long_factors(panel, factors, forward).join(weights, ["date", "factor"])
    combined = rows.groupBy("date", "asset").agg(F.sum(F.col("weight") * F.coalesce("value", F.lit(0.0))).alias("combined"))
    return combined, weights


def mean_weights(weights: DataFrame) -> DataFrame:
    """(factor, weight): each factor's mean weight."""
    return weights.groupBy("factor").agg(F.avg("weight").alias("weight"))


def summary(panel: DataFrame, factors: list[str], method: str = "icir", forward: str = "fwd_return", min_obs: int = 30) -> tuple[DataFrame, DataFrame]:
    """((n_dates, ic_mean, ic_std, icir, positive), (factor, weight)): how a combination's ICs are, and its mean weights.

    ICs are pairwise, of dates with ``min_obs`` names; icir is 0 without deviation.
    """
    combined, weights = combine(panel, factors, method, forward, min_obs=min_obs)
    rows = combined.join(panel.select("date", "asset", forward), ["date", "asset"])
    ics = rank_ic(rows, ["combined"], forward, pairwise=True, min_obs=min_obs).filter(finite(F.col("ic")))
    found = ics.agg(
        F.count("ic").alias("n_dates"),
        F.avg("ic").alias("ic_mean"),
        F.stddev_samp("ic").alias("ic_std"),
        F.avg((F.col("ic") > 0).cast("double")).alias("positive"),
    )
    icir = F.when(F.col("ic_std") > 0, F.col("ic_mean") / F.col("ic_std")).otherwise(0.0)
    return found.withColumn("icir", icir), mean_weights(weights)
