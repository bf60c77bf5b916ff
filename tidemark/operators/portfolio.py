"""Rules as one book: overlap, correlation, capped daily slots, drawdown, capacity. members: rule, date, net."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import SETTINGS, Settings
from tidemark.functions.columns import corr
from tidemark.operators.joins import densify


def daily_pnl(members: DataFrame) -> DataFrame:
    return members.filter("net IS NOT NULL").groupBy("rule", "date").agg(F.avg("net").alias("pnl"))


def signal_overlap(members: DataFrame) -> DataFrame:
    """(rule_a, rule_b, overlap): shared trade dates over all trade dates of each pair of rules, by counts of shared dates."""
    days = members.select("rule", "date").distinct()
    n = days.groupBy("rule").agg(F.count("*").alias("n"))
    a, b = days.select(F.col("rule").alias("rule_a"), "date"), days.select(F.col("rule").alias("rule_b"), "date")
    both = a.join(b, "date").filter("rule_a < rule_b").groupBy("rule_a", "rule_b").agg(F.count("*").alias("c"))
    rules = n.select(F.col("rule").alias("rule_a"), F.col("n").alias("na"))
    pairs = rules.join(n.select(F.col("rule").alias("rule_b"), F.col("n").alias("nb")), F.col("rule_a") < F.col("rule_b"))  # rules are a short list
    c = F.coalesce("c", F.lit(0))
    return pairs.join(both, ["rule_a", "rule_b"], "left").select("rule_a", "rule_b", F.bround(c / (F.col("na") + F.col("nb") - c), 3).alias("overlap"))


def pnl_correlation(members: DataFrame, s: Settings = SETTINGS, least_days: int = 20) -> DataFrame:
    """(rule_a, rule_b, corr, days, flagged): correlation of daily results over common days."""
    p = daily_pnl(members)
    a, b = p.select(F.col("rule").alias("rule_a"), "date", F.col("pnl").alias("x")), p.select(F.col("rule").alias("rule_b"), "date", F.col("pnl").alias("y"))
    out = a.join(b, "date").filter("rule_a < rule_b").groupBy("rule_a", "rule_b").agg(corr("x", "y").alias("corr"), F.count("*").alias("days"))
    return out.withColumn("flagged", F.coalesce((F.abs("corr") > s.port_corr_max) & (F.col("days") >= least_days), F.lit(False)))


def slotted(members: DataFrame, order: list[str], s: Settings = SETTINGS) -> DataFrame:
    """Trades with their place in the day (by `order`, then rule) and whether a slot is left for them."""
    place = F.row_number().over(Window.partitionBy("date").orderBy("rule", *order))
    return members.filter("net IS NOT NULL").withColumn("place", place).withColumn("kept", F.col("place") <= s.port_max_concurrent)


def book_days(members: DataFrame, order: list[str], s: Settings = SETTINGS) -> DataFrame:
    """(date, pnl, trades, equity, drawdown_pct) for each business day: the slots' sum over all slots, in percent."""
    trades = slotted(members, order, s)
    day = trades.groupBy("date").agg((F.sum(F.when(F.col("kept"), F.col("net"))) / s.port_max_concurrent).alias("pnl"), F.count("*").alias("trades")).withColumn("book", F.lit(1))
    full = densify(day, ["book"], business=True, fill={"pnl": 0.0, "trades": 0})
    w = Window.partitionBy("book").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row for each day
    out = full.withColumn("equity", F.exp(F.sum(F.ln(1 + F.col("pnl") / 100)).over(w)))
    return out.withColumn("drawdown_pct", (F.col("equity") / F.max("equity").over(w) - 1) * 100).drop("book")


def combined_book(members: DataFrame, order: list[str], s: Settings = SETTINGS) -> DataFrame:
    """The book's figures in one row."""
    trades = slotted(members, order, s)
    days = book_days(members, order, s)
    a = days.agg(
        F.count_if(F.col("pnl") != 0).alias("n_trade_days"), F.count("*").alias("n_calendar_days"), (F.avg("pnl") * 252).alias("_r"), (F.stddev_samp("pnl") * F.sqrt(F.lit(252.0))).alias("_v"), F.min("drawdown_pct").alias("_d")
    )
    b = trades.agg(F.count("*").alias("n_trades_total"), F.count_if(~F.col("kept")).alias("n_trades_capped_out"))
    c = trades.groupBy("date").agg(F.count("*").alias("k")).agg(
        F.percentile("k", 0.5).cast("long").alias("concurrency_p50"), F.percentile("k", 0.95).cast("long").alias("concurrency_p95"), F.max("k").alias("concurrency_max")
    )
    r, v, d = F.bround("_r", 2), F.bround("_v", 2), F.bround("_d", 2)
    return a.crossJoin(b).crossJoin(c).select(  # one row each
        "n_trade_days", "n_calendar_days", "n_trades_total", "n_trades_capped_out", r.alias("ann_return_pct"), v.alias("ann_vol_pct"), F.when(F.col("_v") > 0, F.bround(F.col("_r") / F.col("_v"), 2)).alias("sharpe"),
        d.alias("max_drawdown_pct"), F.when(F.col("_d") < 0, F.bround(F.col("_r") / F.abs("_d"), 2)).alias("calmar"), "concurrency_p50", "concurrency_p95", "concurrency_max",
    )


def capacity(members: DataFrame, value: str | None = "open30_value", s: Settings = SETTINGS) -> DataFrame:
    """How much a rule can carry: a share of the median value traded where it enters."""
    v = F.percentile(F.col(value).cast("double"), 0.5) if value and value in members.columns else F.lit(None).cast("double")
    out = members.groupBy("rule").agg(F.count("*").alias("n_events"), F.coalesce(v, F.lit(s.default_traded_value)).alias("_m"))
    most = F.col("_m") * s.port_capacity_pct / 100
    return out.select("rule", "n_events", F.bround("_m", 0).alias("median_entry_value"), F.bround(most, 0).alias("max_notional"), F.bround(most / s.trade_value, 1).alias("vs_assumed_trade_size"))
