"""Daily factors. Every column is known at the day's open, as far as its source is.

Families are functions from a daily frame (symbol, date, ...) to the frame with more columns; a family whose
source isn't there is left out, so the schema follows the registry of sources. Columns of one family share their
window specifications, so Catalyst sorts each symbol's rows once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import business_day, carried, flag, over_zero, pct_change_of, rolling_max, rolling_mean, rolling_min, rolling_pct_rank, rolling_std, rolling_sum, series
from tidemark.operators.joins import asof, densify, exact, leave_one_out_median, member_flag, near_flag
from tidemark.sources.readers import PLACE, Registry


def _first(t: DataFrame, by: list[str], **values: str) -> DataFrame:
    """Of each key's rows the first in the table: (by..., values by their new names)."""
    kept = F.struct(*(F.col(c).alias(n) for n, c in values.items()))
    return t.groupBy(*by).agg(F.min_by(kept, PLACE).alias("_kept")).select(*by, "_kept.*")


def _last(t: DataFrame, by: list[str], **values: str) -> DataFrame:
    kept = F.struct(*(F.col(c).alias(n) for n, c in values.items()))
    return t.groupBy(*by).agg(F.max_by(kept, PLACE).alias("_kept")).select(*by, "_kept.*")


def price_volume(daily: DataFrame) -> DataFrame:
    """daily: symbol, date, open, high, low, close, volume and, where known, open_volume of the first half hour."""
    w = series()
    c, o, h, low, v = (F.col(x) for x in ("close", "open", "high", "low", "volume"))
    before = F.lag(c).over(w)
    d = daily.withColumns({"_filled": carried(c, w), "_prev": before})
    span = F.when(F.col("_prev").isNotNull(), F.greatest(h - low, F.abs(h - F.col("_prev")), F.abs(low - F.col("_prev"))))
    gap = over_zero(o - F.col("_prev"), F.col("_prev")) * 100
    d = d.withColumns({
        "gap_pct": gap, "_tr": span, "_chg": pct_change_of(F.col("_filled"), w), "_chg5": pct_change_of(F.col("_filled"), w, 5), "_chg20": pct_change_of(F.col("_filled"), w, 20),
        "_rng": over_zero(h - low, c) * 100, "_up": flag(c - F.col("_prev") > 0),
    })
    run_start = F.coalesce((F.col("_up") != F.lag("_up").over(w)).cast("int"), F.lit(1))
    d = d.withColumn("_run", F.sum(run_start).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("symbol", "_run").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"_streak": F.sum("_up").over(inside), "_length": F.count("*").over(inside)})
    atr = F.lag(over_zero(rolling_mean(F.col("_tr"), w, 14), c)).over(w) * 100
    mean, spread = rolling_mean(c, w, 20, 1), rolling_std(c, w, 20, 1)
    columns = {
        "gap_abs": F.abs("gap_pct"), "gap_dir": F.signum("gap_pct"),
        "ret_1d": F.lag("_chg").over(w) * 100, "ret_5d": F.lag("_chg5").over(w) * 100, "ret_20d": F.lag("_chg20").over(w) * 100,
        "atr14_pct": atr, "rv20": rolling_std(F.col("_chg"), w, 20, 1) * F.sqrt(F.lit(252.0)) * 100,
        "range_compression": over_zero(rolling_mean(F.col("_rng"), w, 5, 1), rolling_mean(F.col("_rng"), w, 60, 1)),
        "rvol_20d": over_zero(F.lag(v).over(w), rolling_mean(v, w, 20, 2)),
        "dist_prev_high": over_zero(o - F.lag(h).over(w), F.col("_prev")) * 100, "dist_prev_low": over_zero(o - F.lag(low).over(w), F.col("_prev")) * 100,
        "dist_52w_high": over_zero(o, rolling_max(h, w, 252, 1)) - 1, "dist_52w_low": over_zero(o, rolling_min(low, w, 252, 1)) - 1,
        "up_streak": F.lag("_streak").over(w), "signed_streak": F.lag(F.when(F.col("_up") == 1, F.col("_length")).otherwise(-F.col("_length"))).over(w),
        "zscore_20d": over_zero(o - mean, spread),
        "day_of_week": F.weekday("date"), "is_month_end": flag((F.last_day("date") == F.col("date")) | (F.day("date") >= 28)),
    }
    if "open_volume" in daily.columns:
        columns["rvol_open30"] = over_zero(F.col("open_volume"), rolling_mean(F.col("open_volume"), w, 20, 1))
    d = d.withColumns(columns).withColumn("gap_vs_atr", over_zero(F.col("gap_abs"), F.col("atr14_pct")))
    return d.drop("_filled", "_prev", "_tr", "_chg", "_chg5", "_chg20", "_rng", "_up", "_run", "_streak", "_length")


def _daily(reg: Registry, key: str, value: str | None = None) -> DataFrame | None:
    """(date, value): a market-wide series' last value of each day."""
    s = reg.get(key, value)
    return None if s is None else s.filter("value IS NOT NULL").groupBy(F.to_date("ts").alias("date")).agg(F.max_by("value", "ts").alias("value"))


def market(frame: DataFrame, reg: Registry, strict_asof: bool = False, base: DataFrame | None = None) -> DataFrame:
    """Market-wide factors. base: the frame's keys by a short plan. strict_asof: foreign closes count from the next day on, where rows bear the session's own date.

    All of them depend on the date alone, so they are put together on the calendar, one row a day, and joined to the frame once.
    """
    base = (frame if base is None else base).select("date").distinct()
    whole = Window.partitionBy(F.lit(0)).orderBy("date")  # a market-wide series is one short calendar

    def change(s: DataFrame, k: int = 1):
        return s.withColumn("_f", carried(F.col("value"), whole)).withColumn("_c", pct_change_of(F.col("_f"), whole, k) * 100)

    out = base
    if (s := _daily(reg, "nifty")) is not None:
        c = s.withColumns({"_1": pct_change_of(F.col("value"), whole), "_5": pct_change_of(F.col("value"), whole, 5), "_m": rolling_mean(F.col("value"), whole, 50)})
        c = c.select("date", (F.lag("_1").over(whole) * 100).alias("nifty_ret_1d"), (F.lag("_5").over(whole) * 100).alias("nifty_ret_5d"), F.lag(flag(F.col("value") > F.col("_m"))).over(whole).alias("nifty_above_50dma"))
        out = exact(out, c, ["date"])
    if (s := _daily(reg, "india_vix")) is not None:
        v = F.col("value")
        c = s.select("date", F.lag(v).over(whole).alias("vix_level"), rolling_pct_rank(v, whole, 252).alias("_r"), pct_change_of(v, whole).alias("_c"))
        c = c.select("date", "vix_level", (F.lag("_c").over(whole) * 100).alias("vix_chg_1d"), F.lag("_r").over(whole).alias("vix_pctile_1y"))
        out = exact(out, c, ["date"])
    # Series that are looked up as of the day, with their change over 1 (or 5) rows.
    for key, name, k in (("sp500", "sp500_overnight", 1), ("crude", "crude_ret_1d", 1), ("crude", "crude_ret_5d", 5), ("usdinr", "usdinr_ret_1d", 1), ("us_vix", "usvix_ret_1d", 1),
                         ("us_10y", "us10y_ret_1d", 1), ("dollar_index", "dxy_ret_1d", 1), ("gold", "gold_ret_1d", 1), ("copper", "copper_ret_1d", 1)):
        if (s := _daily(reg, key)) is not None:
            out = asof(out, change(s, k).select("date", F.col("_c").alias(name)), [name], strict=strict_asof, calendar=base)
    if (s := _daily(reg, "us_vix")) is not None:
        out = asof(out, s.select("date", F.col("value").alias("usvix_level")), ["usvix_level"], strict=strict_asof, calendar=base)
    for key, name in (("nikkei", "nikkei_ret_1d"), ("hang_seng", "hsi_ret_1d")):
        if (s := _daily(reg, key)) is not None:
            out = asof(out, change(s).select("date", F.lag("_c").over(whole).alias(name)), [name], calendar=base)
    if (g := _daily(reg, "gift_nifty", "niftyopen")) is not None and (s := _daily(reg, "nifty")) is not None:
        out = asof(out, g.select("date", F.col("value").alias("_g")), ["_g"], calendar=base)
        out = exact(out, s.select("date", F.lag("value").over(whole).alias("_n")), ["date"]).withColumn("gift_premium_pct", over_zero(F.col("_g") - F.col("_n"), F.col("_n")) * 100).drop("_g", "_n")
    if (s := _daily(reg, "rbi_repo", "repo_rate")) is not None:
        c = s.select("date", F.col("value").alias("repo_rate"), F.coalesce((F.col("value") != F.lag("value", 5).over(whole)).cast("int"), F.lit(1)).alias("repo_chg_recent"))
        out = asof(out, c, ["repo_rate", "repo_chg_recent"], calendar=base)
    if (t := reg.get("fii_dii")) is not None and "fii_net" in t.columns:
        n = F.col("fii_net").cast("double")
        c = _last(t, ["date"], fii_net="fii_net").select("date", F.lag(n).over(whole).alias("fii_net_prev"), rolling_sum(n, whole, 5, 1).alias("fii_net_5d"))
        out = exact(out, c, ["date"])
    if (t := reg.get("cpi_wpi_iip")) is not None:
        out = member_flag(out, t, ["date"], "macro_release_today")
    if (t := reg.get("nse_holidays")) is not None:
        for name, step in (("pre_holiday", 1), ("post_holiday", -1)):
            days = t.select(F.col("date").alias("_h")).distinct()
            out = out.withColumn("_h", business_day(F.col("date"), step))
            out = member_flag(out, days, ["_h"], name).drop("_h")
    return frame.join(F.broadcast(out), "date", "left") if len(out.columns) > 1 else frame  # a row for each day


def derivatives(frame: DataFrame, reg: Registry) -> DataFrame:
    """Option and future factors of the day before."""
    w, out = series(), frame
    if (t := reg.get("options")) is not None:
        names = [c for c in ("pcr", "iv", "iv_percentile", "oi_change", "max_pain") if c in t.columns]
        out = exact(out, t.select("symbol", "date", *(F.lag(c).over(w).alias(f"opt_{c}") for c in names)), ["symbol", "date"])
    if (t := reg.get("futures")) is not None:
        names = [c for c in ("basis", "oi", "oi_change", "rollover") if c in t.columns]
        more = {f"fut_{c}": F.lag(c).over(w) for c in names}
        if {"oi_change", "basis"} <= set(names):
            build = flag((F.col("oi_change") > 0) & (F.col("basis") - F.lag("basis").over(w) > 0))
            t = t.withColumn("_b", build)
            more["fut_long_buildup"] = F.lag("_b").over(w)
        out = exact(out, t.select("symbol", "date", *(c.alias(n) for n, c in more.items())), ["symbol", "date"])
    return out


def events(frame: DataFrame, reg: Registry) -> DataFrame:
    """Earnings, ex-dates and news. News are lagged on the trading calendar, so a day after news has a value."""
    out, keys = frame, ["symbol", "date"]
    if (t := reg.get("earnings_dates")) is not None:
        out = member_flag(out, t, keys, "earnings_today")
        out = member_flag(out, t.select("symbol", F.date_add("date", 1).alias("date")), keys, "earnings_yesterday")
    if (t := reg.get("corporate_actions")) is not None:
        kept = t.filter(F.col("type").isin("dividend", "split", "bonus")) if "type" in t.columns else t
        out = member_flag(out, kept, keys, "exdate_today")
    if (t := reg.get("news")) is not None:
        day = t.groupBy(*keys).agg(F.avg("sentiment").alias("_s"), F.count("*").alias("_n"))
        w = series()
        out = exact(out, day, keys).withColumns({"news_sentiment": F.lag("_s").over(w), "news_count": F.coalesce(F.lag("_n").over(w), F.lit(0))}).drop("_s", "_n")
        out = out.withColumn("has_news", flag(F.col("news_count") > 0))
    return out


def smart_money(frame: DataFrame, reg: Registry, base: DataFrame | None = None) -> DataFrame:
    """Delivery, bans, participants, shorts, bulk deals, sector rotation, pledges, index changes."""
    w, out, keys = series(), frame, ["symbol", "date"]
    whole = Window.partitionBy(F.lit(0)).orderBy("date")
    if (t := reg.get("delivery")) is not None:
        if "series" in t.columns:  # EQ rows where a symbol has any
            has = F.max((F.col("series") == "EQ").cast("int")).over(Window.partitionBy("symbol"))
            t = t.withColumn("_has", has).filter((F.col("_has") == 0) | (F.col("series") == "EQ"))
        x = F.col("delivery_pct").cast("double")
        d = _first(t, keys, delivery_pct="delivery_pct")
        d = d.select(*keys, F.lag(x).over(w).alias("delivery_pct"), over_zero(F.lag(x).over(w) - rolling_mean(x, w, 20, 1), rolling_std(x, w, 20, 1)).alias("delivery_z20"))
        out = exact(out, d, keys)
    if (t := reg.get("fno_ban")) is not None:
        out = member_flag(out, t, keys, "fno_ban_today")
        out = out.withColumn("fno_ban_exit", flag((F.lag("fno_ban_today").over(w) == 1) & (F.col("fno_ban_today") == 0)))
    if (t := reg.get("participant_oi")) is not None:
        ls = over_zero(F.col("fii_fut_long"), F.col("fii_fut_short"))
        p = _first(t, ["date"], **{c: c for c in t.columns if c not in ("date", PLACE)}).withColumns({"_ls": ls, "_pc": over_zero(F.col("client_opt_put_oi"), F.col("client_opt_call_oi"))})
        p = p.select("date", F.lag("_ls").over(whole).alias("fii_fut_long_short"), (F.lag("_ls").over(whole) - F.lag("_ls", 6).over(whole)).alias("fii_fut_ls_chg5d"), F.lag("_pc").over(whole).alias("client_opt_pcr"))
        out = exact(out, p, ["date"])
    if (t := reg.get("short_selling")) is not None:
        s = _first(t, keys, _q="short_qty", _t="traded_qty").withColumn("_p", over_zero(F.col("_q"), F.col("_t")) * 100)
        s = s.select(*keys, F.lag("_p").over(w).alias("short_interest_pct"), rolling_pct_rank(F.col("_p"), w, 90).alias("_r")).withColumn("si_pctile_90d", F.lag("_r").over(w)).drop("_r")
        out = exact(out, s, keys)
    if (t := reg.get("bulk_deals")) is not None:
        sign = F.when(F.upper("buy_sell") == "BUY", 1).when(F.upper("buy_sell") == "SELL", -1).otherwise(0)
        b = t.groupBy(*keys).agg(F.sum(sign * F.col("value_inr").cast("double")).alias("_v"))
        spans = b.groupBy("symbol").agg(F.min("date").alias("_a"), F.max("date").alias("_z"))
        days = spans.select("symbol", F.explode(F.sequence("_a", F.date_add("_z", 6))).alias("date"))
        b = days.join(b, keys, "left").fillna({"_v": 0.0})
        b = b.select(*keys, rolling_sum(F.col("_v"), w, 5, 1).alias("bulk_deal_net5d"))
        out = exact(out, b, keys).fillna({"bulk_deal_net5d": 0.0})
        out = out.withColumn("bulk_deal_recent", flag(F.col("bulk_deal_net5d") != 0))
    sectors = reg.get("sector_map")
    if (t := reg.get("sector_rotation")) is not None and sectors is not None:
        by = Window.partitionBy("sector").orderBy("date")
        r = _first(t, ["sector", "date"], _r="rs_ratio", _m="rs_momentum")
        r = r.select("sector", "date", F.lag("_r").over(by).alias("sector_rs_ratio"), F.lag("_m").over(by).alias("sector_rs_momentum"))
        out = out.join(sectors, "symbol", "left").join(r, ["sector", "date"], "left").drop("sector")
    if (t := reg.get("promoter_pledges")) is not None:
        p = densify(_first(t, keys, _p="pledge_pct").withColumn("_p", F.col("_p").cast("double")), ["symbol"], business=False)
        p = p.withColumn("_p", carried(F.col("_p"), w)).select(*keys, F.col("_p").alias("pledge_pct"), (F.col("_p") - F.lag("_p", 90).over(w)).alias("pledge_chg_90d"))
        out = asof(out, p, ["pledge_pct", "pledge_chg_90d"], by=["symbol"], calendar=frame if base is None else base)
    if (t := reg.get("constituent_changes")) is not None:
        for name, start in (("index_inclusion_window", "INC"), ("index_exclusion_window", "EXC")):
            out = near_flag(out, t.filter(F.upper("action").startswith(start)), 10, ["symbol"], name)
    return out


def cross_section(frame: DataFrame, sectors: DataFrame | None = None, x: str = "gap_pct") -> DataFrame:
    """The day's median gap of the other symbols, and of the other symbols of the sector."""
    out = leave_one_out_median(frame, ["date"], x, "mkt_gap_median").withColumn("gap_idiosyncratic", F.col(x) - F.col("mkt_gap_median"))
    if sectors is not None:
        out = leave_one_out_median(out.join(sectors, "symbol", "left"), ["date", "sector"], x, "sector_gap_median")
        out = out.withColumn("gap_vs_sector", F.col(x) - F.col("sector_gap_median")).drop("sector")
    return out


def assemble(daily: DataFrame, reg: Registry | None = None, strict_asof: bool = True) -> DataFrame:
    """All families whose sources are there."""
    if reg is None:
        return cross_section(price_volume(daily))
    base = daily.select("symbol", "date")
    out = cross_section(price_volume(daily), reg.get("sector_map"))
    for family in (lambda f: market(f, reg, strict_asof, base), lambda f: derivatives(f, reg), lambda f: events(f, reg), lambda f: smart_money(f, reg, base)):
        out = family(out)
    return out
