"""Layered backtests: groups by rank, their returns, values and performance, for any number of factors in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from factorloom.functions.columns import average_rank, ratio
from factorloom.operators.evaluate import ic_summary, long_factors, rank_ic

PERIODS = 52


def equal_width_group(share: Column, day: WindowSpec, groups: int) -> Column:
    """1 to ``groups`` by which part of the range of the date's rank shares a share lies in, bounds belonging to the lower."""
    low, high = F.min(share).over(day), F.max(share).over(day)
    above = [F.when(share > i * ((high - low) / groups) + low, 1).otherwise(0) for i in range(1, groups)]
    return F.when(share.isNotNull(), sum(above, F.lit(1)))


def grouped(panel: DataFrame, factors: list[str], forward: str | None = "fwd_return", groups: int = 5, min_obs: int | None = None) -> DataFrame:
    """(date, asset, factor, forward, grp) of the rows with both value and return, on dates with at least 5 names a group; a value is enough if ``forward`` is None."""
    least = groups * 5 if min_obs is None else min_obs
    if forward is None:
        rows = long_factors(panel.withColumn("_none", F.lit(None).cast("double")), factors, "_none").filter(F.col("value").isNotNull())
    else:
        rows = long_factors(panel, factors, forward).filter(F.col("value").isNotNull() & F.col("forward").isNotNull())
    day = Window.partitionBy("date", "factor")
    shares = rows.withColumn("share", average_rank(F.col("value"), day) / F.count("value").over(day))
    marked = shares.withColumn("n", F.count("value").over(day)).withColumn("grp", equal_width_group(F.col("share"), day, groups))
    return marked.filter(F.col("n") >= least).select("date", "asset", "factor", "forward", "grp")


def group_returns(panel: DataFrame, factors: list[str], forward: str = "fwd_return", groups: int = 5, min_obs: int | None = None) -> DataFrame:
    """(factor, date, G1 … Gn, LS): the groups' mean returns, and the highest's less the lowest's, 0 if one is empty."""
    marked = grouped(panel, factors, forward, groups, min_obs)
    means = [F.avg(F.when(F.col("grp") == g, F.col("forward"))).alias(f"G{g}") for g in range(1, groups + 1)]
    found = marked.groupBy("factor", "date").agg(*means)
    return found.withColumn("LS", F.coalesce(F.col(f"G{groups}") - F.col("G1"), F.lit(0.0)))


def group_values(returns: DataFrame, columns: list[str]) -> DataFrame:
    """(factor, date, …): what one unit has become; dates without a return change nothing; NULL after a loss of everything."""
    so_far = Window.partitionBy("factor").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    values = []
    for c in columns:
        x = F.col(c)
        lost = F.coalesce(F.max(x <= -1).over(so_far), F.lit(False))
        grown = F.exp(F.coalesce(F.sum(F.when(x > -1, F.log1p(x))).over(so_far), F.lit(0.0)))
        values.append(F.when(~lost & x.isNotNull(), grown).alias(c))
    return returns.select("factor", "date", *values)


def performance(returns: DataFrame, columns: list[str], horizon: int = 1) -> DataFrame:
    """(factor, grp, n_dates, annual_return, annual_vol, sharpe) of group returns; sharpe is 0 without deviation."""
    rows = returns.unpivot(["factor", "date"], columns, "grp", "r")
    found = rows.groupBy("factor", "grp").agg(
        F.count("r").alias("n_dates"),
        (F.avg("r") * PERIODS / horizon).alias("annual_return"),
        (F.stddev_samp("r") * F.sqrt(F.lit(PERIODS / horizon))).alias("annual_vol"),
    )
    return found.withColumn("sharpe", F.coalesce(ratio(F.col("annual_return"), F.col("annual_vol")), F.lit(0.0)))


def ic_statistics(panel: DataFrame, factors: list[str], forward: str = "fwd_return", min_obs: int = 30) -> DataFrame:
    """The summary of pairwise daily ICs of dates with at least ``min_obs`` names."""
    return ic_summary(rank_ic(panel, factors, forward, pairwise=True, min_obs=min_obs))


def comparison(panel: DataFrame, factors: list[str], forward: str = "fwd_return", groups: int = 5, min_obs: int = 30) -> DataFrame:
    """A table of strings to look at: IC mean, ICIR, share of positive ICs, the long-short return and its Sharpe ratio."""
    stats = ic_statistics(panel, factors, forward, min_obs)
    made = performance(group_returns(panel, factors, forward, groups), ["LS"]).drop("grp", "n_dates")
    joined = stats.join(made, "factor", "left").orderBy(F.desc_nulls_last("icir"), "factor")
    return joined.select(
        "factor",
        F.format_string("%.4f", "ic_mean").alias("ic_mean"),
        F.format_string("%.4f", "icir").alias("icir"),
        F.format_string("%.1f%%", F.col("positive") * 100).alias("positive"),
        F.format_string("%.2f%%", F.col("annual_return") * 100).alias("annual_return"),
        F.format_string("%.2f", "sharpe").alias("sharpe"),
    )
