"""Panels: one row for each asset and date.

The price panel has open, high, low, close, volume, vwap and returns. It comes
from trades (weekly bars), from events (daily bars), from a table of returns, or
from a table that has the columns already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from factorloom.functions.columns import Frame, nan_to_null, ratio

PRICES = ("open", "high", "low", "close")
FIELDS = (*PRICES, "volume", "vwap", "returns")


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{table}.parquet")


def week_ending_friday(date: Column) -> Column:
    """The Friday on or after a date."""
    return F.next_day(F.date_sub(F.to_date(date), 1), "FRI")


def bars(trades: DataFrame, asset: Column, date: Column, price: Column, size: Column, order: list[Column], returns: bool = True) -> DataFrame:
    """Bars of trades: one aggregation, which combines before its only shuffle; with returns unless told.

    Without returns nothing looks at other rows, so a filter by date or asset
    reaches the trades. order: what makes the order of an asset's trades within a bar; ties left by
    it make open and close arbitrary. Trades without an asset, date or price
    are left out; without a size they count as none.
    """
    named = trades.select(
        asset.alias("asset"),
        date.alias("date"),
        nan_to_null(price.cast("double")).alias("p"),
        F.coalesce(nan_to_null(size.cast("double")), F.lit(0.0)).alias("n"),
        F.struct(*[x.alias(f"k{i}") for i, x in enumerate(order)]).alias("k"),
    ).dropna(subset=["asset", "date", "p"])
    found = named.groupBy("asset", "date").agg(
        F.min_by("p", "k").alias("open"),
        F.max("p").alias("high"),
        F.min("p").alias("low"),
        F.max_by("p", "k").alias("close"),
        F.sum("n").alias("volume"),
        ratio(F.sum(F.col("p") * F.col("n")), F.sum("n")).alias("vwap"),
    )
    return with_returns(found) if returns else found


def with_returns(panel: DataFrame, asset: str = "asset", date: str = "date") -> DataFrame:
    """``panel`` with returns, the change of close since the asset's row before, unless it has them."""
    if "returns" in panel.columns:
        return panel
    last = F.lag("close").over(Frame(asset, date).series)
    return panel.withColumn("returns", ratio(F.col("close"), last) - 1)


def complete(panel: DataFrame, asset: str = "asset", date: str = "date") -> DataFrame:
    """``panel`` with undefined numbers as NULL, and with vwap and returns where they are missing."""
    numbers = [c for c, kind in panel.dtypes if kind in ("double", "float")]
    out = panel.withColumns({c: nan_to_null(F.col(c).cast("double")) for c in numbers})
    if "vwap" not in out.columns:
        out = out.withColumn("vwap", (F.col("high") + F.col("low") + F.col("close")) / 3)
    return with_returns(out, asset, date)


def weekly_panel(spark: SparkSession, folder: str, returns: bool = True) -> DataFrame:
    """Weekly bars of suppliers (assets) from order lines; with returns unless told.

    A bar has two lines or so, so combining them before the shuffle saves little:
    lines are dealt out by asset as they are, once, and the bars and every window
    over a series find their rows where they lie.
    """
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]
    trades = read(spark, folder, "lineitem").select("l_suppkey", *order)
    found = bars(
        trades.repartition("l_suppkey"),
        F.col("l_suppkey"),
        week_ending_friday(F.col("l_shipdate")),
        ratio(F.col("l_extendedprice"), F.col("l_quantity")),
        F.col("l_quantity"),
        [F.col(c) for c in order],
        returns,
    )
    return found


def weekly_universe(spark: SparkSession, folder: str) -> DataFrame:
    """The weekly panel with what style factors take.

    industry (the nation), market_cap (close times all volume so far),
    book_to_price (the supplier's balance over close), roe (mean of 52 returns,
    at least 20), volatility (26 returns' deviation times the root of 52, at
    least 20).
    """
    panel = weekly_panel(spark, folder)
    assets = read(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("asset"), F.col("s_nationkey").alias("industry"), F.col("s_acctbal").alias("balance")
    )
    f = Frame()
    so_far = f.series.rowsBetween(Window.unboundedPreceding, 0)
    year, half = f.last(52), f.last(26)
    return (
        panel.join(assets, "asset")
        .withColumns(
            {
                "market_cap": F.col("close") * F.sum("volume").over(so_far),
                "book_to_price": ratio(F.col("balance"), F.col("close")),
                "roe": F.when(F.count("returns").over(year) >= 20, F.avg("returns").over(year)),
                "volatility": F.when(
                    F.count("returns").over(half) >= 20, F.stddev_samp("returns").over(half) * F.sqrt(F.lit(52.0))
                ),
            }
        )
        .drop("balance")
    )


def daily_event_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars of users (assets) from events, whose value is the price; each counts one."""
    events = read(spark, folder, "events")
    return bars(
        events, F.col("user_id"), F.to_date("ts"), F.col("value"), F.lit(1.0), [F.col("ts"), F.col("event_id")]
    )


def resample_weekly(panel: DataFrame, column: str, how: str = "last") -> DataFrame:
    """(asset, date, value): the last, mean or sample deviation of a column in each week that ends on Friday."""
    made = {
        "last": F.max_by(column, "date"),
        "mean": F.avg(column),
        "std": F.stddev_samp(column),
    }[how]
    rows = panel.filter(F.col(column).isNotNull()).select("asset", "date", column)
    return rows.groupBy("asset", week_ending_friday(F.col("date")).alias("week")).agg(made.alias("value")).select(
        "asset", F.col("week").alias("date"), "value"
    )


def forward_returns(panel: DataFrame, horizon: int = 1, dense: bool = False) -> DataFrame:
    """``panel`` with fwd_return: the returns ``horizon`` rows ahead, or ``horizon`` of the panel's dates ahead if dense."""
    if not dense:
        return panel.withColumn("fwd_return", F.lead("returns", horizon).over(Frame().series))
    dates = panel.select("date").distinct()
    ahead = dates.withColumn("_ahead", F.lead("date", horizon).over(Window.orderBy("date")))
    later = panel.select("asset", F.col("date").alias("_ahead"), F.col("returns").alias("fwd_return"))
    return panel.join(F.broadcast(ahead), "date").join(later, ["asset", "_ahead"], "left").drop("_ahead")


#: Values of a wide table that are put together at once.
TOGETHER = 1_000_000


def wide(panel: DataFrame, column: str, assets: list | None = None) -> DataFrame:
    """One column for each of the named assets, or of all, a row for each date, by date; for export.

    For all assets no expression is made for each: rows go through one pass by
    date, in which a date's values find their places, so the driver holds the
    names of the columns and no more.
    """
    if assets is not None:
        return panel.groupBy("date").pivot("asset", assets).agg(F.first(column)).orderBy("date")
    rows = panel.select("date", "asset", F.col(f"`{column}`").alias("value"))
    names = [r["asset"] for r in rows.select("asset").dropna().distinct().orderBy("asset").collect()]
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = StructType([StructField("date", kinds["date"]), *[StructField(str(a), kinds["value"]) for a in names]])
    width = len(names)

    def made(dates: list, found: list[pa.Array], kind: pa.DataType) -> pa.RecordBatch:
        n = len(dates)
        flat = pa.concat_arrays(found).take(pa.array(np.arange(n * width).reshape(n, width).T.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(dates, kind), *[flat.slice(k * n, n) for k in range(width)]], names=["date", *map(str, names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kind, dates, found = None, None, [], []
        day: list[pa.RecordBatch] = []  # the rows so far of the date that goes on

        def ended() -> None:
            nonlocal known
            own = pa.Table.from_batches(day)
            known = pa.array(names, own.schema.field("asset").type) if known is None else known
            at = pc.index_in(own["asset"].combine_chunks(), value_set=known).fill_null(width).to_numpy()
            place = np.full(width + 1, -1)
            place[at[::-1]] = np.arange(len(own))[::-1]  # of several rows the first
            dates.append(own["date"][0].as_py())
            value = own["value"].combine_chunks()
            found.append(value.take(pa.array(place[:width], mask=place[:width] < 0)))

        for batch in batches:
            if not len(batch):
                continue
            kind = batch.schema.field("date").type
            codes = pc.rank(batch.column(0), tiebreaker="dense").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(batch)]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(start, end - start)
                if day and day[0].column(0)[0] != part.column(0)[0]:
                    ended()
                    day = []
                    if len(dates) * width >= TOGETHER:
                        yield made(dates, found, kind)
                        dates.clear(), found.clear()
                day.append(part)
        if day:
            ended()
            yield made(dates, found, kind)

    return rows.repartitionByRange("date").sortWithinPartitions("date").mapInArrow(run, schema)
