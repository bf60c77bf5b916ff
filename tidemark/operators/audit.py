"""Data audit: jumps, stale prices, days without volume, short histories, late starters; quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import SETTINGS, Settings
from tidemark.functions.columns import over_zero, series
from tidemark.operators.joins import near_flag, without

ISSUE = ["symbol", "date", "issue", "detail", "severity"]


def mechanical(actions: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Corporate actions that move the price by themselves."""
    kind = F.lower(F.col("type").cast("string"))
    return actions.filter(F.coalesce(kind.isin(*s.mechanical_actions) | kind.rlike("|".join(s.mechanical_actions)), F.lit(False))).select("symbol", "date")


def checks(daily: DataFrame, actions: DataFrame | None = None, s: Settings = SETTINGS) -> DataFrame:
    """daily with jump_pct, explained, stale and no_volume."""
    w = series()
    before = F.lag("close").over(w)
    d = daily.withColumns({"jump_pct": over_zero(F.col("open") - before, before) * 100, "_same": F.coalesce((F.col("close") - before) == 0, F.lit(False))})
    d = d.withColumn("_run", F.sum((~F.col("_same")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("symbol", "_run").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"flat_days": F.sum(F.col("_same").cast("int")).over(run), "no_volume": F.coalesce(F.col("volume") <= 0, F.lit(False)), "jump": F.coalesce(F.abs("jump_pct") > s.audit_jump_pct, F.lit(False))})
    d = d.withColumn("stale", F.col("flat_days") >= s.audit_stale_days).drop("_same", "_run")
    if actions is None:
        return d.withColumn("explained", F.lit(0))
    return near_flag(d, mechanical(actions, s), 1, ["symbol"], "explained")


def quarantined(checked: DataFrame) -> DataFrame:
    return checked.filter("jump OR stale OR no_volume").select("symbol", "date").distinct()


def issues(checked: DataFrame, universe_known: bool = True, s: Settings = SETTINGS) -> DataFrame:
    """One row for each finding: symbol, date, issue, detail, severity."""
    none = F.lit(None).cast("date")
    jumps = checked.filter("jump").select(
        "symbol", "date", F.when(F.col("explained") == 1, "explained_corporate_action_jump").otherwise("UNEXPLAINED_JUMP_probable_unadjusted_data").alias("issue"),
        F.format_string("overnight jump %+.1f%%", "jump_pct").alias("detail"), F.when(F.col("explained") == 1, "info").otherwise("CRITICAL").alias("severity"),
    )
    each = checked.groupBy("symbol").agg(F.count_if("stale").alias("_s"), F.count_if("no_volume").alias("_z"), F.count("*").alias("_n"), F.min("date").alias("_first"))
    row = lambda cond, name, detail: each.filter(cond).select("symbol", none.alias("date"), F.lit(name).alias("issue"), detail.alias("detail"), F.lit("warning").alias("severity"))
    out = jumps.unionByName(row("_s > 0", "stale_price_runs", F.format_string(f"%d days inside >= {s.audit_stale_days}-day flat runs", "_s")))
    out = out.unionByName(row("_z > 0", "zero_volume_days", F.format_string("%d days", "_z")))
    out = out.unionByName(row(F.col("_n") < s.audit_min_history_days, "short_history", F.format_string("only %d trading days", "_n")))
    if not universe_known:
        start = each.withColumn("_least", F.min("_first").over(Window.partitionBy(F.lit(0))))  # one row for each symbol
        late = start.agg(F.count_if(F.datediff("_first", "_least") > 365).alias("_l"), F.count("*").alias("_n"))
        text = F.format_string("no universe file; %d/%d symbols start >1y after the earliest", "_l", "_n")
        out = out.unionByName(late.select(F.lit("*UNIVERSE*").alias("symbol"), none.alias("date"), F.lit("SURVIVORSHIP_RISK_no_pit_universe_file").alias("issue"), text.alias("detail"), F.lit("CRITICAL").alias("severity")))
    return out.select(*ISSUE)


def by_severity(report: DataFrame) -> DataFrame:
    return report.groupBy("severity").agg(F.count("*").alias("n"))


def apply_quarantine(panel: DataFrame, quarantine: DataFrame) -> DataFrame:
    return without(panel, quarantine)
