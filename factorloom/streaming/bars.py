"""The daily panel of an event stream, kept up as events come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_bars(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(asset, date, open, high, low, close, volume, vwap) of a stream of (user_id, ts, event_id, value).

    Days are windows of event time; those whose events may still come within
    ``late`` are open. Events without a user, time or value are left out.
    """
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).dropna(subset=["user_id", "ts", "value"])
    order = F.struct("ts", "event_id")
    return (
        stamped.withWatermark("ts", late)
        .groupBy(F.window("ts", "1 day").alias("day"), F.col("user_id").alias("asset"))
        .agg(
            F.min_by("value", order).alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", order).alias("close"),
            F.count("*").cast("double").alias("volume"),
            F.avg("value").alias("vwap"),
        )
        .select("asset", F.to_date("day.start").alias("date"), "open", "high", "low", "close", "volume", "vwap")
    )
