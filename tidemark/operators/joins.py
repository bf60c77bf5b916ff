"""Joins on keys, dates and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, series: DataFrame, values: list[str], by: list[str] | None = None, on: str = "date", strict: bool = False, calendar: DataFrame | None = None) -> DataFrame:
    """left with the series' last row at or before (strict: before) each date, even if that row's values are missing.

    The dates of left and of the series are merged and the last row carried over them; left itself is only joined on
    the date at the end, so it isn't sorted. calendar: where left's dates come from, if that is a shorter plan than left;
    chains of lookups need it, for each would otherwise hold its left side twice.
    """
    by = by or []
    asked = (left if calendar is None else calendar).select(*by, on).distinct().select(*by, on, F.lit(None).cast(series.select(F.struct(*values).alias("s")).schema["s"].dataType).alias("row"), F.lit(0 if strict else 1).alias("place"))
    given = series.filter(F.col(on).isNotNull()).select(*by, on, F.struct(*values).alias("row"), F.lit(1 if strict else 0).alias("place"))
    w = Window.partitionBy(*by).orderBy(on, "place").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.lit(1 if strict else 0)
    met = asked.unionByName(given).withColumn("last", F.last("row", ignorenulls=True).over(w)).filter(F.col("place") != mark)
    return left.join(met.select(*by, on, *(F.col(f"last.{v}").alias(v) for v in values)), [*by, on], "left")


def exact(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    return left.join(right, by, "left")


def member_flag(left: DataFrame, keys: DataFrame, by: list[str], name: str) -> DataFrame:
    """A column that is 1 where the key is among `keys`, else 0."""
    return left.join(keys.select(*by).distinct().withColumn("_in", F.lit(1)), by, "left").withColumn(name, F.coalesce("_in", F.lit(0))).drop("_in")


def near_flag(left: DataFrame, events: DataFrame, days: int, by: list[str], name: str, on: str = "date") -> DataFrame:
    """1 where an event of the same key lies within so many calendar days before or after. Events are spread over their
    days first, so the join is on equal keys."""
    spread = events.select(*by, F.explode(F.sequence(F.date_sub(on, days), F.date_add(on, days))).alias(on))
    return member_flag(left, spread, [*by, on], name)


def in_universe(events: DataFrame, universe: DataFrame | None, on: str = "date") -> DataFrame:
    """Events whose symbol was in the universe that day; without a universe all of them."""
    if universe is None:
        return events
    u = universe.select(F.col("symbol").alias("_s"), "from_date", F.coalesce("to_date", F.lit("9999-12-31").cast("date")).alias("to_date"))
    return events.join(u, (events["symbol"] == F.col("_s")) & (events[on] >= F.col("from_date")) & (events[on] <= F.col("to_date")), "left_semi")


def without(events: DataFrame, quarantine: DataFrame, by: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    return events.join(quarantine.select(*by).distinct(), list(by), "left_anti")


def calendar(start: Column, end: Column) -> Column:
    return F.sequence(start, end)


def densify(df: DataFrame, by: list[str], business: bool, fill: dict | None = None, on: str = "date") -> DataFrame:
    """One row for each day (or each Monday to Friday) between a key's first and last date; `fill` where there was none."""
    spans = df.groupBy(*by).agg(F.min(on).alias("_a"), F.max(on).alias("_b"))
    days = spans.select(*by, F.explode(F.sequence("_a", "_b")).alias(on))
    if business:
        days = days.filter(F.weekday(on) < 5)
    out = days.join(df, [*by, on], "left")
    return out.fillna(fill) if fill else out


def leave_one_out_median(df: DataFrame, by: list[str], x: str, name: str) -> DataFrame:
    """The median of the other rows' values in each group.

    Of a group only its size, its median and the four values around its middle travel to its rows: what is left when a row's
    own value goes out is told by the side of the middle on which the value stands.
    """
    v = F.col(x).cast("double")
    held = df.filter(F.col(x).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(v)).alias("_v"))
    n = F.size("_v")
    at = lambda k: F.get("_v", k.cast("int") - 1)  # noqa: E731  the k-th value, from 1
    low, high = F.floor(n / 2), F.floor((n + 1) / 2)
    middle = held.select(*by, n.alias("_n"), ((at(high) + at(F.floor(n / 2) + 1)) / 2).alias("_m"), at(low).alias("_a"), at(low + 1).alias("_b"), at(high).alias("_c"), at(high + 1).alias("_d"))
    rest = (F.when(v > F.col("_a"), F.col("_a")).otherwise(F.col("_b")) + F.when(v > F.col("_c"), F.col("_c")).otherwise(F.col("_d"))) / 2
    others = F.when(v.isNull(), F.col("_m")).when(F.col("_n") > 1, rest)
    return df.join(middle, by, "left").withColumn(name, others).drop("_n", "_m", "_a", "_b", "_c", "_d")
