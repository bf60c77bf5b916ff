"""Bars: from ticks to bars, from minute bars to days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")


def between_time(df: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Rows whose time of day lies between start and end, both included."""
    return df.filter(clock(F.col(ts)).between(start, end))


def _first(x: str, by: str) -> Column:
    return F.min_by(x, F.when(F.col(x).isNotNull(), F.col(by)))


def _last(x: str, by: str) -> Column:
    return F.max_by(x, F.when(F.col(x).isNotNull(), F.col(by)))


def ticks_to_bars(ticks: DataFrame, unit: str, price: str = "price", ts: str = "ts") -> DataFrame:
    """(symbol, ts, open, high, low, close, volume) for each unit of time ('minute', 'hour', 'day'); volume counts ticks."""
    at = F.date_trunc(unit, F.col(ts)).alias("ts")
    return ticks.groupBy("symbol", at).agg(
        _first(price, ts).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), _last(price, ts).alias("close"),
        F.count(price).cast("double").alias("volume"),
    )


def to_daily(bars: DataFrame) -> DataFrame:
    """One row for each symbol and day: first open, highest high, lowest low, last close (nulls skipped), total volume."""
    return bars.groupBy("symbol", F.to_date("ts").alias("date")).agg(
        _first("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), _last("close", "ts").alias("close"), F.sum("volume").alias("volume")
    )


def open_window(bars: DataFrame, start: str = "09:15", end: str = "09:45") -> DataFrame:
    """(symbol, date, open_volume, open_value): volume and traded value in the day's first minutes."""
    inside = clock(F.col("ts")).between(start, end)
    return bars.groupBy("symbol", F.to_date("ts").alias("date")).agg(
        F.coalesce(F.sum(F.when(inside, F.col("volume"))), F.lit(0.0)).alias("open_volume"),
        F.sum(F.when(inside, F.col("volume") * F.col("close"))).alias("open_value"),
    )


def last_per_day(series: DataFrame, value: str = "value") -> DataFrame:
    """(date, value): the last value of each calendar day that has one."""
    return series.filter(F.col(value).isNotNull()).groupBy(F.to_date("ts").alias("date")).agg(F.max_by(value, "ts").alias("value"))
