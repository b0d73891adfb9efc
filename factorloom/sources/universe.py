"""Universes that are made up or read from files."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.functions.columns import Frame, clip, nan_to_null, ratio
from factorloom.sources.panel import week_ending_friday

INDUSTRIES = 30


def synthetic_universe(
    spark: SparkSession,
    n_assets: int = 300,
    start: str = "2015-01-05",
    end: str = "2024-12-31",
    seed: int = 42,
) -> DataFrame:
    """(asset, date, industry, returns, market_cap, book_to_price, roe, momentum_12m, volatility), weekly.

    Every number follows from a hash of its asset, date and ``seed``, so rows
    are made in place, in any number of tasks, and always the same. Returns are
    beta (0.5 to 1.5) times a market's normal(0.0015, 0.025) plus a normal(0,
    0.04) of their own; log caps start at normal(23, 1.5) and follow 0.3 of the
    returns; book to price and return on equity are random walks within bounds.
    """

    def uniform(salt: int, *keys: str):
        return (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *map(F.col, keys)), F.lit(1 << 53)) + 0.5) / float(1 << 53)

    def normal(salt: int, *keys: str):
        radius = F.sqrt(-2 * F.log(uniform(salt, *keys)))
        return radius * F.cos(2 * math.pi * uniform(salt + 1, *keys))

    first = week_ending_friday(F.to_date(F.lit(start)))
    dates = spark.range(1).select(F.explode(F.sequence(first, F.to_date(F.lit(end)), F.expr("interval 7 days"))).alias("date"))
    assets = spark.range(n_assets).select(F.lpad((F.col("id") + 1).cast("string"), 6, "0").alias("asset"))
    assets = assets.withColumn("industry", F.format_string("IND%02d", F.floor(uniform(1, "asset") * INDUSTRIES).cast("int") + 1))
    # a table of dates is some hundred rows, whatever the number of assets
    rows = assets.withColumn("one", F.lit(1)).join(F.broadcast(dates.withColumn("one", F.lit(1))), "one").drop("one")
    made = rows.withColumn(
        "returns",
        (0.0015 + 0.025 * normal(3, "date")) * (0.5 + uniform(5, "asset")) + 0.04 * normal(7, "asset", "date"),
    ).withColumns(
        {
            "_book": 0.3 + 1.7 * uniform(9, "asset"),
            "_book_step": 0.05 * normal(11, "asset", "date"),
            "_roe": 0.02 + 0.23 * uniform(13, "asset"),
            "_roe_step": 0.01 * normal(15, "asset", "date"),
        }
    )
    f = Frame()
    so_far = f.series.rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.sum(c).over(so_far)
    count = lambda n: F.count("returns").over(f.last(n))
    return made.select(
        "asset",
        "date",
        "industry",
        "returns",
        F.exp(23 + 1.5 * normal(17, "asset") + 0.3 * total("returns")).alias("market_cap"),
        clip(F.col("_book") + total("_book_step"), F.lit(0.1), F.lit(5.0)).alias("book_to_price"),
        clip(F.col("_roe") + total("_roe_step"), F.lit(-0.1), F.lit(0.6)).alias("roe"),
        F.when(count(52) >= 40, F.sum("returns").over(f.last(52))).alias("momentum_12m"),
        F.when(count(26) >= 20, F.stddev_samp("returns").over(f.last(26)) * math.sqrt(52)).alias("volatility"),
    )


def ohlcv_from_returns(universe: DataFrame, seed: int = 42) -> DataFrame:
    """Prices that returns make: close is their running product from 1, open the close before, high and low around it.

    The first row of an asset has a close of 1. Missing returns count as 0.
    Returns of -1 or less have no log, and the close is NULL from there on.
    """
    f = Frame()
    so_far = f.series.rowsBetween(Window.unboundedPreceding, 0)
    unit = lambda salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "asset", "date"), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    normal = lambda salt: F.sqrt(-2 * F.log(unit(salt))) * F.cos(2 * math.pi * unit(salt + 1))
    step = F.when(F.row_number().over(f.series) == 1, 0.0).otherwise(F.coalesce(nan_to_null(F.col("returns")), F.lit(0.0)))
    rows = universe.withColumn("_step", step)
    broken = F.max(F.col("_step") <= -1).over(so_far)
    close = F.when(~broken, F.exp(F.sum(F.when(F.col("_step") > -1, F.log1p("_step"))).over(so_far)))
    rows = rows.withColumn("close", close)
    rows = rows.withColumns(
        {
            "open": F.coalesce(F.lag("close").over(f.series), F.col("close")),
            "high": F.col("close") * (1 + F.abs(0.01 * normal(1))),
            "low": F.col("close") * (1 - F.abs(0.01 * normal(3))),
            "volume": F.exp(18 + normal(5)),
        }
    )
    return rows.withColumn("vwap", (F.col("high") + F.col("low") + F.col("close")) / 3).drop("_step")


def read_daily_bars(spark: SparkSession, path: str, kind: str = "parquet", columns: dict[str, str] | None = None) -> DataFrame:
    """Daily bars (asset, date, open, high, low, close, volume) from files; malformed rows give NULLs.

    columns: names in the files by ours.
    """
    reader = spark.read.option("mode", "PERMISSIVE")
    rows = reader.option("header", True).csv(path) if kind == "csv" else reader.format(kind).load(path)
    names = {c: c for c in ("asset", "date", "open", "high", "low", "close", "volume")} | (columns or {})
    kinds = {"asset": "string", "date": "date"}
    return rows.select(*[F.expr(f"try_cast(`{own}` AS {kinds.get(c, 'double')})").alias(c) for c, own in names.items()])


def universe_from_bars(bars: DataFrame, least_rows: int = 100) -> DataFrame:
    """A weekly universe from daily closes, with stand-ins for fundamentals.

    Assets of fewer than ``least_rows`` rows are left out. cap: close times a
    million; book to price: 1 over close (at least 1); return on equity: mean of
    52 weeks of the weekly mean return times 252, at least 20; volatility: the
    weekly deviation times the root of 252; momentum: the sum of 52 weekly
    returns, at least 40; industry: a hash of the asset.
    """
    rows = bars.filter(F.col("close").isNotNull())
    enough = rows.groupBy("asset").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least_rows).select("asset")
    rows = rows.join(enough, "asset", "left_semi")
    f = Frame()
    rows = rows.withColumn("_r", ratio(F.col("close"), F.lag("close").over(f.series)) - 1)
    weekly = rows.groupBy("asset", week_ending_friday(F.col("date")).alias("date")).agg(
        F.max_by("close", "date").alias("close"),
        F.avg("_r").alias("_mean"),
        F.stddev_samp("_r").alias("_deviation"),
    )
    weekly = weekly.withColumn("returns", ratio(F.col("close"), F.lag("close").over(f.series)) - 1)
    count = lambda c, n: F.count(c).over(f.last(n))
    return weekly.select(
        "asset",
        "date",
        F.format_string("IND%02d", F.pmod(F.xxhash64("asset"), F.lit(INDUSTRIES))).alias("industry"),
        "close",
        "returns",
        (F.col("close") * 1e6).alias("market_cap"),
        (1 / F.greatest(F.col("close"), F.lit(1.0))).alias("book_to_price"),
        F.when(count("_mean", 52) >= 20, F.avg("_mean").over(f.last(52)) * 252).alias("roe"),
        F.when(count("returns", 52) >= 40, F.sum("returns").over(f.last(52))).alias("momentum_12m"),
        (F.col("_deviation") * math.sqrt(252)).alias("volatility"),
    )
