"""Outcomes of events: continuation of gaps, reversion to the day's average price, and path-aware barriers.

Paths are windows over a day's bars, or a join of each event with its own day's bars; no bar is visited in a loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import SETTINGS, Settings
from tidemark.functions.columns import over_zero
from tidemark.operators.bars import between_time

DAY = ["symbol", "date"]


def numbered(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars with date, place in the day from 0, and the day's number of bars."""
    d = bars if start is None else between_time(bars, start, end)
    d = d.withColumn("date", F.to_date("ts"))
    return d.withColumns({"i": F.row_number().over(Window.partitionBy(*DAY).orderBy("ts")) - 1, "bars": F.count("*").over(Window.partitionBy(*DAY))})


def day_range(bars: DataFrame, entries: DataFrame) -> DataFrame:
    """entries with atr_pct: ten times the mean bar range before the entry (five bars at least), 0.3 or more."""
    span = over_zero(F.col("high") - F.col("low"), F.col("close")) * 100
    early = bars.join(entries.select(*DAY, F.greatest(F.col("entry"), F.lit(5)).alias("_upto")), DAY).filter("i < _upto")
    return entries.join(early.groupBy(*DAY).agg((F.avg(span) * 10).alias("_a")), DAY, "left").withColumn("atr_pct", F.greatest(F.col("_a"), F.lit(0.3))).drop("_a")


def triple_barrier(bars: DataFrame, entries: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """entries (symbol, date, entry, direction, atr_pct) with tb_ret and tb_hit.

    Which comes first within the next bars: profit (1), stop (-1, also where one bar has both) or time (0)?
    """
    base = bars.join(entries.select(*DAY, F.col("entry").alias("_e")), DAY).filter("i = _e").select(*DAY, F.col("close").alias("_in"))
    aims = entries.join(base, DAY).withColumns({
        "_up": F.col("_in") * (1 + F.col("direction") * s.tb_up_mult * F.col("atr_pct") / 100), "_dn": F.col("_in") * (1 - F.col("direction") * s.tb_dn_mult * F.col("atr_pct") / 100),
    })
    path = bars.join(aims, DAY).filter((F.col("i") > F.col("entry")) & (F.col("i") <= F.col("entry") + s.tb_max_min))
    long = F.col("direction") > 0
    won = F.when(long, F.col("high") >= F.col("_up")).otherwise(F.col("low") <= F.col("_up"))
    lost = F.when(long, F.col("low") <= F.col("_dn")).otherwise(F.col("high") >= F.col("_dn"))
    ends = path.groupBy(*DAY).agg(F.min(F.when(won, F.col("i"))).alias("_w"), F.min(F.when(lost, F.col("i"))).alias("_l"), F.max_by("close", "i").alias("_out"))
    stop = F.col("_l").isNotNull() & (F.col("_w").isNull() | (F.col("_l") <= F.col("_w")))
    out = aims.join(ends, DAY, "left")
    hit = F.when(F.col("_out").isNull(), None).when(stop, -1).when(F.col("_w").isNotNull(), 1).otherwise(0)
    gain = F.when(F.col("_out").isNull(), None).when(stop, -s.tb_dn_mult * F.col("atr_pct")).when(F.col("_w").isNotNull(), s.tb_up_mult * F.col("atr_pct"))
    return out.withColumns({"tb_hit": hit, "tb_ret": gain.otherwise(F.col("direction") * over_zero(F.col("_out") - F.col("_in"), F.col("_in")) * 100)}).drop("_in", "_up", "_dn", "_w", "_l", "_out")


def gap_go(bars: DataFrame, gaps: DataFrame, s: Settings = SETTINGS, start: str | None = "09:15", end: str | None = "15:30", least_bars: int = 5) -> DataFrame:
    """Outcomes of days that open with a gap of gap_min_pct or more. gaps: symbol, date, gap_pct."""
    d = numbered(bars, start, end)
    big = gaps.filter(F.abs("gap_pct") >= s.gap_min_pct).select(*DAY, "gap_pct")
    day = d.filter(F.col("bars") >= least_bars).join(big, DAY)
    sign, close = F.signum("gap_pct"), F.col("close")
    firsts = day.groupBy(*DAY, "gap_pct").agg(
        F.min_by("open", "i").alias("_o"), F.max_by("close", "i").alias("_c"), *(F.max_by("close", F.when(F.col("i") < max(h, 1), F.col("i"))).alias(f"_c{h}") for h in s.gap_go_horizons)
    )
    moved = lambda c: sign * over_zero(F.col(c) - F.col("_o"), F.col("_o")) * 100
    out = firsts.withColumns({f"cont_{h}m": moved(f"_c{h}") for h in s.gap_go_horizons} | {"cont_close": moved("_c"), "_before": over_zero(F.col("_o"), 1 + F.col("gap_pct") / 100)})
    out = out.withColumns({f"go_{h}m": (F.col(f"cont_{h}m") > 0).cast("int") for h in s.gap_go_horizons})
    touched = day.join(out.select(*DAY, "_before"), DAY).groupBy(*DAY).agg(F.max(((F.col("low") <= F.col("_before")) & (F.col("high") >= F.col("_before"))).cast("int")).alias("filled_gap"))
    entries = out.select(*DAY, F.lit(0).alias("entry"), F.signum("gap_pct").alias("direction"))
    barriers = triple_barrier(d, day_range(d, entries), s).select(*DAY, "tb_ret", "tb_hit")
    names = [f"cont_{h}m" for h in s.gap_go_horizons] + [f"go_{h}m" for h in s.gap_go_horizons]
    return out.join(touched, DAY).join(barriers, DAY).select(*DAY, "gap_pct", *names, "filled_gap", "cont_close", "tb_ret", "tb_hit")


def mean_reversion(bars: DataFrame, s: Settings = SETTINGS, start: str | None = "09:15", end: str | None = "15:00", least_bars: int = 60, warm_up: int = 30) -> DataFrame:
    """The day's first bar far from the volume-weighted price (in expanding deviations), and how far price comes back.

    Days whose first such bar comes before `warm_up` bars or too late for the longest horizon are left out.
    """
    w = Window.partitionBy(*DAY).orderBy("i")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    d = numbered(bars, start, end).filter(F.col("bars") >= least_bars)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    d = d.withColumn("_vwap", over_zero(F.sum(typical * F.col("volume")).over(so_far), F.sum("volume").over(so_far)))
    d = d.withColumn("_dev", F.col("close") - F.col("_vwap"))
    spread = F.when(F.count("_dev").over(so_far) >= warm_up, F.stddev_samp("_dev").over(so_far))
    d = d.withColumn("_z", over_zero(F.col("_dev"), spread))
    first = d.filter(F.abs("_z") >= s.mr_zscore_entry).groupBy(*DAY).agg(F.min_by(F.struct("i", "_z", "_dev", "close", "ts", "bars"), "i").alias("t")).select(*DAY, "t.*")
    longest = max(s.mr_horizons)
    picked = first.filter((F.col("i") >= warm_up) & (F.col("i") <= F.col("bars") - longest))
    entries = picked.select(*DAY, F.col("i").alias("entry"), (-F.signum("_dev")).alias("direction"), F.col("_z").alias("mr_z"), F.date_format("ts", "HH:mm").alias("mr_time"), F.col("close").alias("_p"), F.col("bars").alias("_n"))
    later = d.select(*DAY, "i", "close").join(entries, DAY)
    at = lambda h: F.max(F.when(F.col("i") == F.least(F.col("entry") + h, F.col("_n") - 1), F.col("close")))
    prices = later.groupBy(*DAY).agg(*(at(h).alias(f"_c{h}") for h in s.mr_horizons))
    out = entries.join(prices, DAY)
    out = out.withColumns({f"revert_{h}m": F.col("direction") * over_zero(F.col(f"_c{h}") - F.col("_p"), F.col("_p")) * 100 for h in s.mr_horizons})
    out = out.withColumns({f"rev_{h}m": (F.col(f"revert_{h}m") > 0).cast("int") for h in s.mr_horizons})
    barriers = triple_barrier(d, day_range(d, entries.select(*DAY, "entry", "direction")), s).select(*DAY, "tb_ret", "tb_hit")
    names = [f"revert_{h}m" for h in s.mr_horizons] + [f"rev_{h}m" for h in s.mr_horizons]
    return out.join(barriers, DAY).select(*DAY, "mr_z", "mr_time", *names, "tb_ret", "tb_hit")
