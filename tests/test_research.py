"""Bars to reports on synthetic bars with a planted edge; sources, sinks and streams."""

import datetime as dt
from dataclasses import replace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.config import SETTINGS
from tidemark.operators import bars
from tidemark.plans import research
from tidemark.sources import readers, sinks, synthetic
from tidemark.streaming import live

S = replace(SETTINGS, train_end="2024-06-30", min_events=30, boundary_dates=("2024-05-31", "2024-06-30", "2024-08-30"), n_permutations=40, n_bootstrap=100, gp_population=8, gp_generations=1)


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("market"))
    synthetic.write_sample(spark, path, symbols=3, days=260)
    days = spark.read.parquet(f"{path}/nifty.parquet").select("date")
    sinks.write_parquet(spark.createDataFrame([("TEST00", "auto"), ("TEST01", "auto"), ("TEST02", "bank")], "symbol string, sector string"), f"{path}/sector_map.parquet")
    for key in ("sp500", "crude", "us_vix", "nikkei"):
        sinks.write_parquet(synthetic.synthetic_series(spark, key, 260), f"{path}/{key}.parquet")
    some = days.filter(F.pmod(F.xxhash64("date"), F.lit(9)) == 0)
    sinks.write_parquet(some, f"{path}/nse_holidays.parquet")
    sinks.write_parquet(some.select(F.lit("TEST00").alias("symbol"), "date"), f"{path}/earnings_dates.parquet")
    sinks.write_parquet(some.select(F.lit("TEST01").alias("symbol"), "date", F.lit(0.5).alias("sentiment")), f"{path}/news.parquet")
    both = days.crossJoin(spark.createDataFrame([("TEST00",), ("TEST01",)], "symbol string"))
    x = F.pmod(F.xxhash64("symbol", "date"), F.lit(100)).cast("double")
    sinks.write_parquet(both.select("symbol", "date", x.alias("delivery_pct"), F.lit("EQ").alias("series")), f"{path}/delivery.parquet")
    sinks.write_parquet(both.select("symbol", "date", x.alias("short_qty"), F.lit(1000.0).alias("traded_qty")), f"{path}/short_selling.parquet")
    sinks.write_parquet(both.filter(x < 5).select("symbol", "date", F.lit("BUY").alias("buy_sell"), x.alias("value_inr")), f"{path}/bulk_deals.parquet")
    sinks.write_parquet(both.filter(x < 3).select("symbol", "date", x.alias("pledge_pct")), f"{path}/promoter_pledges.parquet")
    sinks.write_parquet(both.filter(x < 2).select("symbol", "date", F.lit("INCLUDE").alias("action"), F.lit("i").alias("index_name")), f"{path}/constituent_changes.parquet")
    sinks.write_parquet(both.filter(x < 9).select("symbol", "date"), f"{path}/fno_ban.parquet")
    sinks.write_parquet(days.select("date", *(F.lit(v).alias(n) for n, v in (("fii_fut_long", 3.0), ("fii_fut_short", 2.0), ("client_opt_put_oi", 1.0), ("client_opt_call_oi", 4.0)))), f"{path}/participant_oi.parquet")
    sinks.write_parquet(days.select("date", F.lit(1.0).alias("fii_net"), F.lit(2.0).alias("dii_net")), f"{path}/fii_dii.parquet")
    for kind, names in (("options", ("pcr", "iv")), ("futures", ("basis", "oi_change"))):
        sinks.write_parquet(days.select("date", *(F.rand(1).alias(n) for n in names)), f"{path}/{kind}/TEST00.parquet")
    return path


@pytest.fixture(scope="module")
def gap_panel(spark, root):
    sinks.write_parquet(research.build_panels(spark, root, s=S).gap, f"{root}/panel")
    return spark.read.parquet(f"{root}/panel")


def test_synthetic_bars_are_the_same_however_dealt(spark):
    a, b = (synthetic.synthetic_bars(spark, 2, 5).repartition(k).groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.sum("close"), 6).alias("c")).orderBy("symbol").collect() for k in (1, 7))
    assert a == b and a[0].n == 5 * 375


def test_sources(spark, root):
    assert sorted(r.symbol for r in readers.discover_symbols(spark, root).collect()) == ["TEST00", "TEST01", "TEST02"]
    one = readers.minute_bars(spark, root, ["TEST01"])
    assert [r.symbol for r in one.select("symbol").distinct().collect()] == ["TEST01"]
    assert readers.daily_series(spark, root, "nifty").columns == ["ts", "value"]
    assert readers.daily_series(spark, root, "gold") is None and readers.keyed_table(spark, root, "rbi_repo") is None
    assert readers.per_symbol_table(spark, root, "options").filter("symbol = 'TEST00'").count() == 260
    assert readers.find_root(spark, ["/nowhere", root]) == root and readers.universe(spark, root) is None


def test_panel_has_every_family(spark, root, gap_panel):
    have = set(gap_panel.columns)
    assert {
        "gap_pct", "rvol_open30", "nifty_ret_1d", "vix_pctile_1y", "sp500_overnight", "crude_ret_5d", "usvix_level", "nikkei_ret_1d", "pre_holiday", "opt_iv", "fut_long_buildup", "earnings_today", "news_count",
        "delivery_z20", "fno_ban_exit", "fii_fut_long_short", "fii_net_5d", "si_pctile_90d", "bulk_deal_net5d", "pledge_pct", "index_inclusion_window", "mkt_gap_median", "gap_vs_sector", "ms_vpin", "ms_amihud_z20", "cost_pct",
        "cont_30m", "filled_gap", "tb_hit", "open30_value",
    } <= have
    assert gap_panel.count() > 200 and gap_panel.groupBy("symbol", "date").count().filter("count > 1").count() == 0
    assert gap_panel.filter("abs(gap_pct) < 0.5").count() == 0


def test_strategy_finds_the_planted_edge(spark, gap_panel, tmp_path):
    few = gap_panel.select("symbol", "date", "event_id", "open30_value", "cost_pct", "cont_30m", "rvol_open30", "day_of_week", "zscore_20d", "nifty_ret_1d")
    done = research.run_strategy(few, "cont_30m", "gap", str(tmp_path), S, deep=False)
    level1 = {r.factor: r for r in done["single_factors"].collect()}
    assert level1["rvol_open30"].best_mean > 0.1 and level1["rvol_open30"].fdr_pass
    assert {"hypotheses", "single_factors", "combinations", "thresholds", "regimes", "lead_lag", "sequences", "calendar"} <= set(done)
    sinks.write_text(spark, research.summary("gap", {k: done[k] for k in ("single_factors", "calendar")}), f"{tmp_path}/report")
    assert spark.read.text(f"{tmp_path}/report").count() > 5
    # Rules run the gauntlet if they are confirmed and survive false discovery control, and only then.
    tested = {r.rule for r in done["gauntlet"].collect()} if "gauntlet" in done else set()
    assert tested == {f"L1:{r.factor}" for r in level1.values() if r.confirmed and r.fdr_pass}
    assert "L1:rvol_open30" in tested and "boundaries" in done


def test_trade_sheet(spark):
    rows = [("A", dt.date(2024, 1, 2), 1.0, 5.0), ("B", dt.date(2024, 1, 2), -0.9, 9.0), ("C", dt.date(2024, 1, 2), 0.1, 9.0), ("A", dt.date(2024, 1, 3), 2.0, 9.0)]
    frame = spark.createDataFrame(rows, "symbol string, date date, gap_pct double, x double")
    got = research.score_day(frame, {"r1": F.col("x") > 4, "r2": F.col("x") > 8}, {"r1": 0.2, "r2": 0.5}, "2024-01-02", {"r2"}).collect()
    assert [(r.symbol, r.rule, r.direction, r.action) for r in got] == [("B", "r2", -1.0, "DO_NOT_TRADE"), ("A", "r1", 1.0, "TRADE"), ("B", "r1", -1.0, "TRADE")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a|b", [1.0, 2.0], 0.12345)], "n string, xs array<double>, v double")
    sinks.write_csv(df, f"{tmp_path}/c", single=True)
    assert readers.result_csv(spark, f"{tmp_path}/c").first().xs == "[1.0,2.0]"
    assert readers.result_csv(spark, f"{tmp_path}/missing") is None
    assert sinks.markdown_table(df).splitlines()[-1] == "| a\\|b | [1.0, 2.0] | 0.1235 |"


def test_streams(spark, tmp_path):
    ticks = pd.DataFrame({"symbol": ["A"] * 5, "ts": pd.to_datetime(["2024-01-01 09:15:01", "2024-01-01 09:15:30", "2024-01-01 09:15:59", "2024-01-01 09:16:10", "2024-01-01 10:00:00"]), "price": [1.0, 3.0, 2.0, 5.0, 9.0]})
    spark.createDataFrame(ticks).write.parquet(f"{tmp_path}/ticks")
    stream = spark.readStream.schema("symbol string, ts timestamp, price double").parquet(f"{tmp_path}/ticks")
    q = live.bar_stream(stream).writeStream.format("memory").queryName("bars_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.open, r.high, r.low, r.close, r.volume) for r in spark.table("bars_out").collect()}
    batch = {(r.open, r.high, r.low, r.close, r.volume) for r in bars.ticks_to_bars(spark.read.parquet(f"{tmp_path}/ticks"), "minute").collect()}
    assert got == batch == {(1.0, 3.0, 1.0, 2.0, 3.0), (5.0, 5.0, 5.0, 5.0, 1.0), (9.0, 9.0, 9.0, 9.0, 1.0)}


def test_drift_stream(spark, tmp_path):
    rows = [("r", dt.date(2024, 1, 1) + dt.timedelta(days=i), -1.0, 0.0, 1.0) for i in range(15)]
    spark.createDataFrame(rows, "rule string, date date, net double, mu double, sd double").write.parquet(f"{tmp_path}/r")
    stream = spark.readStream.schema("rule string, date date, net double, mu double, sd double").parquet(f"{tmp_path}/r")
    q = live.drift_stream(stream).writeStream.format("memory").queryName("drift_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.date, round(r.cusum, 6), r.alarm) for r in spark.table("drift_out").collect())
    assert [x[1] for x in got] == pytest.approx([0.75 * (i + 1) for i in range(15)]) and [x[2] for x in got].index(True) == 10


def test_market_factors_by_words_anywhere_in_the_name():
    from tidemark.plans.research import market_factors

    assert market_factors(["usvix_ret_1d", "rvol_20d", "gap_vs_sector", "nifty_ret_1d"]) == ["usvix_ret_1d", "gap_vs_sector", "nifty_ret_1d"]
    assert market_factors(["rvol_20d"]) == []
