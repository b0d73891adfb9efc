"""Turnover of layered groups and what trading costs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.columns import ratio
from factorloom.operators.backtest import PERIODS, grouped


@dataclass(frozen=True)
class Costs:
    """Shares of a trade's value: commission, tax on sales, market impact at full participation; min_commission isn't charged."""

    commission: float = 0.0003
    stamp_tax: float = 0.0005
    impact: float = 0.1
    min_commission: float = 5.0


def trade_cost(value: Column, daily_volume: Column, is_buy: Column, costs: Costs = Costs()) -> Column:
    """What share of its value a trade costs: commission, tax on a sale, and impact.

    Impact goes by the root of the trade's share of the day's volume, which is
    1 at most, and 0.01 where there's no volume.
    """
    share = F.when(daily_volume > 0, F.least(F.abs(value) / daily_volume, F.lit(1.0))).otherwise(0.01)
    tax = F.when(is_buy, 0.0).otherwise(costs.stamp_tax)
    return F.lit(costs.commission) + tax + costs.impact * F.sqrt(share)


def turnover(old: DataFrame, new: DataFrame, value: float = 1e8, costs: Costs = Costs(), keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, turnover, buys, sells, cost, cost_bps) from (keys, asset, weight) to (keys, asset, weight).

    Assets of one side only have weight 0 on the other. All buys, and all
    sales, are priced as one trade at a daily volume of 1e8.
    """
    on = [*keys, "asset"]
    both = old.withColumnRenamed("weight", "_old").join(new.withColumnRenamed("weight", "_new"), on, "full_outer")
    moved = F.coalesce("_new", F.lit(0.0)) - F.coalesce("_old", F.lit(0.0))
    sums = both.groupBy(*keys).agg(
        (F.sum(F.abs(moved)) / 2).alias("turnover"),
        (F.sum(F.greatest(moved, F.lit(0.0))) * value).alias("buys"),
        (F.sum(F.greatest(-moved, F.lit(0.0))) * value).alias("sells"),
    )
    return priced(sums, value, costs)


def priced(sums: DataFrame, value: float, costs: Costs) -> DataFrame:
    """``sums`` (turnover, buys, sells) with cost and cost_bps."""
    volume = F.lit(1e8)
    buys = F.col("buys") * trade_cost(F.col("buys"), volume, F.lit(True), costs)
    sells = F.col("sells") * trade_cost(F.col("sells"), volume, F.lit(False), costs)
    return sums.withColumn("cost", buys + sells).withColumn("cost_bps", F.col("cost") / value * 1e4)


def group_turnover(
    panel: DataFrame,
    factors: list[str],
    groups: int = 5,
    value: float = 1e8,
    costs: Costs = Costs(),
    min_obs: int | None = None,
) -> DataFrame:
    """(factor, grp, date, turnover, buys, sells, cost, cost_bps) of equally weighted groups against their last date.

    Groups are of all names with a value, whether or not a return follows. Group
    0 holds the highest group and owes the lowest. A weight on a date and the negative of the weight on the date before are
    rows of one aggregation, so there's no join of the panel with itself.
    """
    size = F.count(F.lit(1)).over(Window.partitionBy("factor", "grp", "date"))
    marked = grouped(panel, factors, None, groups, min_obs).withColumn("_size", size)
    own = F.struct(F.col("grp").alias("grp"), (1 / F.col("_size")).alias("w"))
    both = F.struct(F.lit(0).alias("grp"), (F.when(F.col("grp") == groups, 1.0).when(F.col("grp") == 1, -1.0) / F.col("_size")).alias("w"))
    weights = marked.select("factor", "date", "asset", F.explode(F.array(own, both)).alias("x")).select("factor", "x.grp", "date", "asset", "x.w")
    weights = weights.filter(F.col("w").isNotNull())
    dates = marked.select("factor", "date").distinct()
    later = dates.withColumn("next", F.lead("date").over(Window.partitionBy("factor").orderBy("date")))
    held = weights.join(later, ["factor", "date"])
    moves = held.select(
        "factor", "grp", "asset", F.explode(F.array(F.struct("date", "w"), F.struct(F.col("next").alias("date"), (-F.col("w")).alias("w")))).alias("m")
    ).select("factor", "grp", "asset", "m.date", "m.w")
    first = dates.groupBy("factor").agg(F.min("date").alias("first"))
    moved = moves.filter(F.col("date").isNotNull()).groupBy("factor", "grp", "date", "asset").agg(F.sum("w").alias("w"))
    sums = (
        moved.join(F.broadcast(first), "factor")
        .filter(F.col("date") > F.col("first"))
        .groupBy("factor", "grp", "date")
        .agg(
            (F.sum(F.abs("w")) / 2).alias("turnover"),
            (F.sum(F.greatest("w", F.lit(0.0))) * value).alias("buys"),
            (F.sum(F.greatest(-F.col("w"), F.lit(0.0))) * value).alias("sells"),
        )
    )
    return priced(sums, value, costs)


def net_returns(gross: DataFrame, turnovers: DataFrame, column: str, grp: int) -> DataFrame:
    """(factor, date, gross, net): a group's returns less its costs; dates without a turnover keep theirs."""
    own = turnovers.filter(F.col("grp") == grp).select("factor", "date", "cost_bps")
    rows = gross.select("factor", "date", F.col(column).alias("gross")).join(own, ["factor", "date"], "left")
    return rows.select("factor", "date", "gross", (F.col("gross") - F.coalesce("cost_bps", F.lit(0.0)) / 1e4).alias("net"))


def turnover_summary(turnovers: DataFrame) -> DataFrame:
    """(factor, grp, mean_turnover, mean_cost_bps, annual_cost) of each group's dates."""
    found = turnovers.groupBy("factor", "grp").agg(
        F.avg("turnover").alias("mean_turnover"), F.avg("cost_bps").alias("mean_cost_bps")
    )
    return found.withColumn("annual_cost", ratio(F.col("mean_cost_bps") * PERIODS, F.lit(1e4)))
