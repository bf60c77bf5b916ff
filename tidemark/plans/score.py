"""The trade sheet of a day: what the stored rules that passed every test say of each symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import SETTINGS, Settings
from tidemark.operators import costs
from tidemark.plans.research import LEAST_BARS, confirmed_rules, feature_frame, level1_condition
from tidemark.sources import readers, sinks

STRATEGIES = ("gap", "reversion")


def stored(spark: SparkSession, out: str, strategy: str, level: str) -> DataFrame | None:
    """A result table of an earlier run, if it was made."""
    return readers.read_if_there(spark, f"{out}/{strategy}_{level}")


def stored_rules(spark: SparkSession, out: str, strategy: str) -> DataFrame | None:
    """(rule, grade, net_mean, drift_ok, max_notional): rules of the two best grades that stand other cut dates and the family-wise test."""
    tables = {k: stored(spark, out, strategy, k) for k in ("gauntlet", "boundaries", "spa", "drift", "capacity")}
    if tables["gauntlet"] is None or tables["boundaries"] is None or tables["spa"] is None:
        return None
    rules = confirmed_rules(tables["gauntlet"], tables["boundaries"], tables["spa"]).select("rule", "grade", "net_mean")
    drift = tables["drift"].select("rule", (~F.col("drift_alarm")).alias("drift_ok")) if tables["drift"] is not None else rules.select("rule", F.lit(True).alias("drift_ok"))
    capacity = tables["capacity"].select("rule", "max_notional") if tables["capacity"] is not None else rules.select("rule", F.lit(None).cast("double").alias("max_notional"))
    return rules.join(drift, "rule", "left").join(capacity, "rule", "left").fillna({"drift_ok": True})


def home_regimes(spark: SparkSession, out: str, strategy: str, day: str) -> DataFrame | None:
    """(rule, regime_ok): whether each rule earns in the market regime of the last day known by then."""
    days, edges = (stored(spark, out, strategy, k) for k in ("market_regimes", "edges_by_regime"))
    if days is None or edges is None:
        return None
    now = days.filter(F.col("date") <= F.lit(day).cast("date")).agg(F.max_by("regime", "date").alias("regime"))  # one row
    return edges.join(F.broadcast(now), "regime").select("rule", F.col("tradeable_in_regime").alias("regime_ok"))


def score_frame(frame: DataFrame, level1: DataFrame, rules: DataFrame, strategy: str, day: str, regimes: DataFrame | None = None, s: Settings = SETTINGS) -> DataFrame:
    """(symbol, strategy, rule, factor_value, direction, expected_net_pct, grade, regime_ok, drift_ok, cost_pct, max_notional, action).

    frame: factors by symbol and date. Rules that drift, or whose regime isn't theirs, are listed but not traded. Rules of formulas
    need their trees, so only those of level 1 are held against the day.
    """
    edges = {f"L1:{r.factor}": r for r in level1.collect() if r.factor in frame.columns}  # a row for each factor
    today = frame.filter(F.col("date") == F.lit(day).cast("date"))
    if strategy == "gap":
        today = today.filter(F.abs("gap_pct") >= s.gap_min_pct)
    value = F.col("open30_value") if "open30_value" in frame.columns else F.lit(s.default_traded_value)
    today = today.withColumn("cost_pct", costs.trade_cost_pct(F.coalesce(value, F.lit(s.default_traded_value)), strategy == "gap", F.col("gap_pct"), s))
    each = [F.when(F.coalesce(level1_condition(r), F.lit(False)), F.struct(F.lit(n).alias("rule"), F.col(r.factor).cast("double").alias("factor_value"))) for n, r in edges.items()]
    none = F.array().cast("array<struct<rule:string,factor_value:double>>")
    hits = today.select("symbol", (F.signum("gap_pct") if strategy == "gap" else F.lit(0.0)).alias("direction"), "cost_pct", F.explode(F.filter(F.array(*each) if each else none, lambda x: x.isNotNull())).alias("r"))
    out = hits.select("symbol", F.lit(strategy).alias("strategy"), "r.*", "direction", "cost_pct").join(F.broadcast(rules), "rule")  # a few rules
    out = out.join(F.broadcast(regimes), "rule", "left") if regimes is not None else out.withColumn("regime_ok", F.lit(None).cast("boolean"))
    held_back = ~F.col("drift_ok") | ~F.coalesce("regime_ok", F.lit(True))
    return out.select(
        "symbol", "strategy", "rule", "factor_value", "direction", F.col("net_mean").alias("expected_net_pct"), "grade", "regime_ok", "drift_ok", "cost_pct", "max_notional",
        F.when(held_back, "DO_NOT_TRADE").otherwise("TRADE").alias("action"),
    ).orderBy(F.col("net_mean").desc(), "symbol", "rule")


def trade_sheet(spark: SparkSession, root: str, out: str, day: str, symbols: list[str] | None = None, s: Settings = SETTINGS) -> DataFrame | None:
    """The sheet of both strategies from bars under `root` and results under `out`; written there as CSV. None without confirmed rules."""
    sheet, frame = None, None
    for strategy in STRATEGIES:
        rules, level1 = stored_rules(spark, out, strategy), stored(spark, out, strategy, "single_factors")
        if rules is None or level1 is None or not rules.limit(1).count():
            continue
        if frame is None:
            minute = readers.minute_bars(spark, root, symbols)
            minute = minute.filter(F.to_date("ts") <= F.lit(day).cast("date"))
            large = minute.groupBy("symbol").agg(F.count("*").alias("_n")).filter(F.col("_n") >= LEAST_BARS).select("symbol")
            frame = feature_frame(minute.join(large, "symbol", "left_semi"), readers.Registry(spark, root))
        found = score_frame(frame, level1, rules, strategy, day, home_regimes(spark, out, strategy, day), s)
        sheet = found if sheet is None else sheet.unionByName(found)
    if sheet is not None:
        sinks.write_csv(sheet.orderBy(F.col("expected_net_pct").desc(), "symbol", "rule"), f"{out}/trade_sheet_{day}", single=True)
    return sheet


def main(argv: list[str] | None = None) -> None:
    import argparse
    import datetime

    parser = argparse.ArgumentParser(description="the trade sheet of a day")
    parser.add_argument("root")
    parser.add_argument("out")
    parser.add_argument("--date", default=datetime.date.today().isoformat())
    parser.add_argument("--symbols", nargs="*")
    a = parser.parse_args(argv)
    if trade_sheet(SparkSession.builder.getOrCreate(), a.root, a.out, a.date, a.symbols) is None:
        print("no confirmed rules")


if __name__ == "__main__":
    main()
