"""The factor families over side tables made of the driver's orders, the other hypotheses, sources and sinks, with their twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import audit, features, hypotheses
from tidemark.plans import samples as S
from tidemark.plans.catalog import query
from tidemark.plans.catalog_discovery import T
from tidemark.sources import readers, sinks

_W = "(PARTITION BY symbol ORDER BY date)"
#: Daily series: which orders, and what of a day's prices.
_SERIES = {
    "nifty": ("true", "max(o_totalprice)"), "india_vix": ("true", "min(o_totalprice)"), "gift_nifty": ("o_orderstatus = 'O'", "max(o_totalprice)"), "rbi_repo": ("o_orderstatus = 'F'", "floor(max(o_totalprice) / 100000)"),
    "sp500": ("o_orderpriority LIKE '1%'", "max(o_totalprice)"), "crude": ("o_orderpriority LIKE '2%'", "max(o_totalprice)"), "usdinr": ("o_orderpriority LIKE '3%'", "max(o_totalprice)"), "us_vix": ("o_orderpriority LIKE '4%'", "max(o_totalprice)"),
    "us_10y": ("o_orderpriority LIKE '5%'", "max(o_totalprice)"), "dollar_index": ("o_orderpriority LIKE '1%'", "min(o_totalprice)"), "gold": ("o_orderpriority LIKE '2%'", "min(o_totalprice)"), "copper": ("o_orderpriority LIKE '3%'", "min(o_totalprice)"),
    "nikkei": ("o_orderpriority LIKE '4%'", "min(o_totalprice)"), "hang_seng": ("o_orderpriority LIKE '5%'", "min(o_totalprice)"),
}
#: Keyed tables as selections from d0 (a row for each order, its key as place) or d (a row for each day).
_TABLES = {
    "fii_dii": ("d0", "date, o_totalprice - 150000 AS fii_net, o_orderkey AS _place", "true"),
    "cpi_wpi_iip": ("d0", "date", "o_totalprice > 400000"),
    "nse_holidays": ("d0", "date", "o_totalprice > 440000"),
    "options": ("d", "symbol, date, high / low AS pcr, volume AS iv, close AS max_pain", "true"),
    "futures": ("d", "symbol, date, close - open AS basis, volume AS oi, high - 200000 AS oi_change", "true"),
    "earnings_dates": ("d0", "symbol, date", "o_totalprice > 420000"),
    "corporate_actions": ("d0", "symbol, date, CASE WHEN o_totalprice > 410000 THEN 'dividend' WHEN o_totalprice > 380000 THEN 'meeting' ELSE 'split' END AS type", "o_totalprice > 380000 OR o_totalprice < 3000"),
    "news": ("d0", "symbol, date, round(o_totalprice / 1000) AS sentiment", "o_totalprice > 200000"),
    "delivery": ("d0", "symbol, date, o_totalprice / 5000 AS delivery_pct, CASE WHEN o_orderpriority LIKE '1%' AND symbol <> 'MACHINERY' THEN 'EQ' ELSE 'BE' END AS series, o_orderkey AS _place", "true"),
    "fno_ban": ("d0", "symbol, date", "o_totalprice > 400000"),
    "participant_oi": ("d0", "date, o_totalprice AS fii_fut_long, o_totalprice + o_custkey AS fii_fut_short, o_custkey AS client_opt_put_oi, o_totalprice AS client_opt_call_oi, o_orderkey AS _place", "true"),
    "short_selling": ("d0", "symbol, date, o_custkey AS short_qty, o_totalprice AS traded_qty, o_orderkey AS _place", "true"),
    "bulk_deals": ("d0", "symbol, date, CASE WHEN o_orderpriority LIKE '1%' THEN 'BUY' WHEN o_orderpriority LIKE '2%' THEN 'sell' ELSE 'hold' END AS buy_sell, round(o_totalprice) AS value_inr", "o_totalprice > 300000"),
    "sector_map": ("d", "DISTINCT symbol, CASE WHEN symbol IN ('BUILDING', 'MACHINERY') THEN 'heavy' ELSE 'light' END AS sector", "symbol <> 'HOUSEHOLD'"),
    "sector_rotation": ("d0", "CASE WHEN symbol IN ('BUILDING', 'MACHINERY') THEN 'heavy' ELSE 'light' END AS sector, date, o_totalprice AS rs_ratio, o_custkey AS rs_momentum, o_orderkey AS _place", "true"),
    "promoter_pledges": ("d0", "symbol, date, o_totalprice / 1000 AS pledge_pct, o_orderkey AS _place", "o_totalprice > 300000"),
    "constituent_changes": ("d0", "symbol, date, CASE WHEN o_totalprice > 400000 THEN 'INCLUDE' ELSE 'Exclude' END AS action", "o_totalprice > 440000 OR o_totalprice < 1500"),
}


class Tables:
    """Stands for a registry of sources: the same keys, made of the driver's tables."""

    def __init__(self, spark, sf):
        o, c = S.tables(spark, sf, "orders", "customer")
        self.rows = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("c_mktsegment").alias("symbol"), F.to_date("o_orderdate").alias("date"), "o_orderkey", "o_totalprice", "o_custkey", "o_orderpriority", "o_orderstatus")
        self.days = S.order_days(spark, sf)

    def get(self, key, value=None):
        if key in _SERIES:
            where, what = _SERIES[key]
            return self.rows.filter(where).groupBy("date").agg(F.expr(what).cast("double").alias("value")).select(F.col("date").cast("timestamp_ntz").alias("ts"), "value")
        if key not in _TABLES:
            return None
        source, columns, where = _TABLES[key]
        rows = (self.days if source == "d" else self.rows).filter(where)
        parts = columns.removeprefix("DISTINCT ")
        out = rows.selectExpr(*_split(parts))
        return out.distinct() if columns.startswith("DISTINCT ") else out


def _split(columns: str) -> list[str]:
    """The columns of a select list: cut at commas outside brackets."""
    out, depth = [""], 0
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


_DAYS = S.DAYS_SQL.replace("o_orderkey, o_totalprice FROM orders", "o_orderkey, o_totalprice, o_custkey, o_orderpriority, o_orderstatus FROM orders")


def _series(*keys: str) -> str:
    return ", ".join(f"s_{k} AS (SELECT date, CAST({_SERIES[k][1]} AS DOUBLE) AS value FROM d0 WHERE {_SERIES[k][0]} GROUP BY date)" for k in keys)


def _tables(*keys: str) -> str:
    return ", ".join(f"t_{k} AS (SELECT {_TABLES[k][1]} FROM {_TABLES[k][0]} WHERE {_TABLES[k][2]})" for k in keys)


_ASOF = [
    ("sp500", "sp500_overnight", 1), ("crude", "crude_ret_1d", 1), ("crude", "crude_ret_5d", 5), ("usdinr", "usdinr_ret_1d", 1), ("us_vix", "usvix_ret_1d", 1), ("us_10y", "us10y_ret_1d", 1), ("dollar_index", "dxy_ret_1d", 1),
    ("gold", "gold_ret_1d", 1), ("copper", "copper_ret_1d", 1),
]
_MARKET = [n for _, n, _ in _ASOF] + ["usvix_level", "nikkei_ret_1d", "hsi_ret_1d", "gift_premium_pct", "repo_rate", "nifty_ret_1d", "nifty_ret_5d", "vix_level", "vix_chg_1d", "vix_pctile_1y", "fii_net_prev", "fii_net_5d"]
_FLAGS = ["nifty_above_50dma", "repo_chg_recent", "macro_release_today", "pre_holiday", "post_holiday"]


@query("market_features", f"""WITH {_DAYS}, {_series(*_SERIES)}, {_tables('fii_dii', 'cpi_wpi_iip', 'nse_holidays')}, cal AS (SELECT DISTINCT date FROM d),
n1 AS (SELECT date, value, value / lag(value) OVER w - 1 AS c1, value / lag(value, 5) OVER w - 1 AS c5, CASE WHEN count(value) OVER w50 = 50 THEN avg(value) OVER w50 END AS m FROM s_nifty WINDOW w AS (ORDER BY date), w50 AS (ORDER BY date ROWS 49 PRECEDING)),
n2 AS (SELECT date, lag(c1) OVER w * 100 AS nifty_ret_1d, lag(c5) OVER w * 100 AS nifty_ret_5d, lag(CASE WHEN value > m THEN 1 ELSE 0 END) OVER w AS nifty_above_50dma, lag(value) OVER w AS nprev FROM n1 WINDOW w AS (ORDER BY date)),
v1 AS (SELECT date, value, list(value) OVER w252 AS xs, lag(value) OVER w AS vix_level, value / lag(value) OVER w - 1 AS c FROM s_india_vix WINDOW w AS (ORDER BY date), w252 AS (ORDER BY date ROWS 251 PRECEDING)),
v2 AS (SELECT date, vix_level, lag(c) OVER w * 100 AS vix_chg_1d, lag(CASE WHEN len(xs) = 252 THEN (len(list_filter(xs, lambda x: x < value)) + (len(list_filter(xs, lambda x: x = value)) + 1) / 2.0) / 252 END) OVER w AS vix_pctile_1y FROM v1 WINDOW w AS (ORDER BY date)),
{', '.join(f"a{i} AS (SELECT date, (value / lag(value, {k}) OVER (ORDER BY date) - 1) * 100 AS {n} FROM s_{key})" for i, (key, n, k) in enumerate(_ASOF))},
{', '.join(f"b{i} AS (SELECT date, lag(c) OVER (ORDER BY date) AS {n} FROM (SELECT date, (value / lag(value) OVER (ORDER BY date) - 1) * 100 AS c FROM s_{key}))" for i, (key, n) in enumerate((('nikkei', 'nikkei_ret_1d'), ('hang_seng', 'hsi_ret_1d'))))},
rp AS (SELECT date, value AS repo_rate, coalesce(CAST(value <> lag(value, 5) OVER (ORDER BY date) AS INTEGER), 1) AS repo_chg_recent FROM s_rbi_repo),
f1 AS (SELECT date, arg_max(fii_net, _place) AS x FROM t_fii_dii GROUP BY date), f2 AS (SELECT date, lag(x) OVER w AS fii_net_prev, CASE WHEN count(x) OVER w5 = 5 THEN sum(x) OVER w5 END AS fii_net_5d FROM f1 WINDOW w AS (ORDER BY date), w5 AS (ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
j AS (SELECT cal.date, {', '.join(f'a{i}.{n}' for i, (_, n, _) in enumerate(_ASOF))}, u.value AS usvix_level, nikkei_ret_1d, hsi_ret_1d, g.value AS gift, repo_rate, repo_chg_recent FROM cal {' '.join(f'ASOF LEFT JOIN a{i} ON cal.date > a{i}.date' for i in range(len(_ASOF)))}
ASOF LEFT JOIN s_us_vix u ON cal.date > u.date ASOF LEFT JOIN b0 ON cal.date >= b0.date ASOF LEFT JOIN b1 ON cal.date >= b1.date ASOF LEFT JOIN s_gift_nifty g ON cal.date >= g.date ASOF LEFT JOIN rp ON cal.date >= rp.date),
z AS (SELECT j.*, (gift - nprev) / nprev * 100 AS gift_premium_pct, nifty_ret_1d, nifty_ret_5d, nifty_above_50dma, vix_level, vix_chg_1d, vix_pctile_1y, fii_net_prev, fii_net_5d, CAST(j.date IN (SELECT date FROM t_cpi_wpi_iip) AS INTEGER) AS macro_release_today,
CAST(j.date + CASE isodow(j.date) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END IN (SELECT date FROM t_nse_holidays) AS INTEGER) AS pre_holiday, CAST(j.date - CASE isodow(j.date) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END IN (SELECT date FROM t_nse_holidays) AS INTEGER) AS post_holiday
FROM j LEFT JOIN n2 ON n2.date = j.date LEFT JOIN v2 ON v2.date = j.date LEFT JOIN f2 ON f2.date = j.date)
SELECT d.symbol, d.date, {', '.join(f'round({c}, 5) AS {c}' for c in _MARKET)}, {', '.join(_FLAGS)} FROM d JOIN z ON z.date = d.date""", dates=("date",))
def market_features(spark, sf):
    t = Tables(spark, sf)
    frame = t.days.select("symbol", "date")
    return S.rounded(features.market(frame, t, strict_asof=True).select("symbol", "date", *_MARKET, *_FLAGS), 5)


@query("derivative_features", f"""WITH {_DAYS}, {_tables('options', 'futures')}, o AS (SELECT symbol, date, lag(pcr) OVER w AS opt_pcr, lag(iv) OVER w AS opt_iv, lag(max_pain) OVER w AS opt_max_pain FROM t_options WINDOW w AS {_W}),
b AS (SELECT *, CASE WHEN oi_change > 0 AND basis - lag(basis) OVER w > 0 THEN 1 ELSE 0 END AS b FROM t_futures WINDOW w AS {_W}), f AS (SELECT symbol, date, lag(basis) OVER w AS fut_basis, lag(oi) OVER w AS fut_oi, lag(oi_change) OVER w AS fut_oi_change, lag(b) OVER w AS fut_long_buildup FROM b WINDOW w AS {_W})
SELECT d.symbol, d.date, round(opt_pcr, 6) AS opt_pcr, opt_iv, opt_max_pain, round(fut_basis, 6) AS fut_basis, fut_oi, round(fut_oi_change, 6) AS fut_oi_change, fut_long_buildup FROM d LEFT JOIN o ON o.symbol = d.symbol AND o.date = d.date LEFT JOIN f ON f.symbol = d.symbol AND f.date = d.date""", dates=("date",))
def derivative_features(spark, sf):
    t = Tables(spark, sf)
    return S.rounded(features.derivatives(t.days.select("symbol", "date"), t))


@query("event_features", f"""WITH {_DAYS}, {_tables('earnings_dates', 'corporate_actions', 'news')}, n AS (SELECT symbol, date, avg(sentiment) AS s, count(*) AS n FROM t_news GROUP BY 1, 2),
k AS (SELECT d.symbol, d.date, lag(s) OVER w AS news_sentiment, coalesce(lag(n) OVER w, 0) AS news_count FROM d LEFT JOIN n ON n.symbol = d.symbol AND n.date = d.date WINDOW w AS (PARTITION BY d.symbol ORDER BY d.date))
SELECT symbol, date, CAST((symbol, date) IN (SELECT (symbol, date) FROM t_earnings_dates) AS INTEGER) AS earnings_today, CAST((symbol, date - 1) IN (SELECT (symbol, date) FROM t_earnings_dates) AS INTEGER) AS earnings_yesterday,
CAST((symbol, date) IN (SELECT (symbol, date) FROM t_corporate_actions WHERE type IN ('dividend', 'split', 'bonus')) AS INTEGER) AS exdate_today, round(news_sentiment, 6) AS news_sentiment, news_count, CASE WHEN news_count > 0 THEN 1 ELSE 0 END AS has_news FROM k""", dates=("date",))
def event_features(spark, sf):
    t = Tables(spark, sf)
    return S.rounded(features.events(t.days.select("symbol", "date"), t))


_SMART = ["delivery_pct", "delivery_z20", "fii_fut_long_short", "fii_fut_ls_chg5d", "client_opt_pcr", "short_interest_pct", "si_pctile_90d", "bulk_deal_net5d", "sector_rs_ratio", "sector_rs_momentum", "pledge_pct", "pledge_chg_90d"]
_SMART_FLAGS = ["fno_ban_today", "fno_ban_exit", "bulk_deal_recent", "index_inclusion_window", "index_exclusion_window"]


@query("smart_money_features", f"""WITH {_DAYS}, {_tables('delivery', 'fno_ban', 'participant_oi', 'short_selling', 'bulk_deals', 'sector_map', 'sector_rotation', 'promoter_pledges', 'constituent_changes')},
e0 AS (SELECT *, max(CASE WHEN series = 'EQ' THEN 1 ELSE 0 END) OVER (PARTITION BY symbol) AS has FROM t_delivery), e1 AS (SELECT symbol, date, arg_min(delivery_pct, _place) AS x FROM e0 WHERE has = 0 OR series = 'EQ' GROUP BY 1, 2),
e2 AS (SELECT symbol, date, lag(x) OVER w AS delivery_pct, CASE WHEN count(x) OVER w20 = 20 THEN (lag(x) OVER w - avg(x) OVER w20) / nullif(stddev_samp(x) OVER w20, 0) END AS delivery_z20 FROM e1 WINDOW w AS {_W}, w20 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
b1 AS (SELECT symbol, date, CAST((symbol, date) IN (SELECT (symbol, date) FROM t_fno_ban) AS INTEGER) AS fno_ban_today FROM d), b2 AS (SELECT *, CASE WHEN lag(fno_ban_today) OVER w = 1 AND fno_ban_today = 0 THEN 1 ELSE 0 END AS fno_ban_exit FROM b1 WINDOW w AS {_W}),
p1 AS (SELECT date, arg_min(fii_fut_long, _place) / arg_min(fii_fut_short, _place) AS ls, arg_min(client_opt_put_oi, _place) / arg_min(client_opt_call_oi, _place) AS pc FROM t_participant_oi GROUP BY date),
p2 AS (SELECT date, lag(ls) OVER w AS fii_fut_long_short, lag(ls) OVER w - lag(ls, 6) OVER w AS fii_fut_ls_chg5d, lag(pc) OVER w AS client_opt_pcr FROM p1 WINDOW w AS (ORDER BY date)),
h1 AS (SELECT symbol, date, arg_min(short_qty, _place) / arg_min(traded_qty, _place) * 100 AS p FROM t_short_selling GROUP BY 1, 2), h2 AS (SELECT symbol, date, p, list(p) OVER (PARTITION BY symbol ORDER BY date ROWS 89 PRECEDING) AS xs, lag(p) OVER w AS short_interest_pct FROM h1 WINDOW w AS {_W}),
h3 AS (SELECT symbol, date, short_interest_pct, lag(CASE WHEN len(xs) = 90 THEN (len(list_filter(xs, lambda x: x < p)) + (len(list_filter(xs, lambda x: x = p)) + 1) / 2.0) / 90 END) OVER w AS si_pctile_90d FROM h2 WINDOW w AS {_W}),
k1 AS (SELECT symbol, date, sum(CASE upper(buy_sell) WHEN 'BUY' THEN value_inr WHEN 'SELL' THEN -value_inr ELSE 0 END) AS v FROM t_bulk_deals GROUP BY 1, 2), k2 AS (SELECT symbol, CAST(unnest(generate_series(a, z + 6, INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT symbol, min(date) AS a, max(date) AS z FROM k1 GROUP BY 1)),
k3 AS (SELECT k2.symbol, k2.date, CASE WHEN count(*) OVER w = 5 THEN sum(coalesce(v, 0)) OVER w END AS x FROM k2 LEFT JOIN k1 ON k1.symbol = k2.symbol AND k1.date = k2.date WINDOW w AS (PARTITION BY k2.symbol ORDER BY k2.date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
r1 AS (SELECT sector, date, arg_min(rs_ratio, _place) AS r, arg_min(rs_momentum, _place) AS m FROM t_sector_rotation GROUP BY 1, 2), r2 AS (SELECT sector, date, lag(r) OVER w AS sector_rs_ratio, CAST(lag(m) OVER w AS DOUBLE) AS sector_rs_momentum FROM r1 WINDOW w AS (PARTITION BY sector ORDER BY date)),
g1 AS (SELECT symbol, date, arg_min(pledge_pct, _place) AS p FROM t_promoter_pledges GROUP BY 1, 2), g2 AS (SELECT symbol, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT symbol, min(date) AS a, max(date) AS z FROM g1 GROUP BY 1)),
g3 AS (SELECT g2.symbol, g2.date, last_value(p IGNORE NULLS) OVER (PARTITION BY g2.symbol ORDER BY g2.date ROWS UNBOUNDED PRECEDING) AS p FROM g2 LEFT JOIN g1 ON g1.symbol = g2.symbol AND g1.date = g2.date), g4 AS (SELECT symbol, date, p AS pledge_pct, p - lag(p, 90) OVER w AS pledge_chg_90d FROM g3 WINDOW w AS {_W}),
x AS (SELECT d.symbol, d.date, g4.pledge_pct, g4.pledge_chg_90d FROM d ASOF LEFT JOIN g4 ON g4.symbol = d.symbol AND d.date >= g4.date),
y AS (SELECT x.*, e2.delivery_pct, e2.delivery_z20, fii_fut_long_short, fii_fut_ls_chg5d, client_opt_pcr, short_interest_pct, si_pctile_90d, coalesce(k3.x, 0.0) AS bulk_deal_net5d, sector_rs_ratio, sector_rs_momentum, fno_ban_today, fno_ban_exit, CASE WHEN coalesce(k3.x, 0) <> 0 THEN 1 ELSE 0 END AS bulk_deal_recent,
CAST(EXISTS (SELECT 1 FROM t_constituent_changes c WHERE c.symbol = x.symbol AND upper(action) LIKE 'INC%' AND abs(date_diff('day', c.date, x.date)) <= 10) AS INTEGER) AS index_inclusion_window,
CAST(EXISTS (SELECT 1 FROM t_constituent_changes c WHERE c.symbol = x.symbol AND upper(action) LIKE 'EXC%' AND abs(date_diff('day', c.date, x.date)) <= 10) AS INTEGER) AS index_exclusion_window
FROM x LEFT JOIN e2 ON e2.symbol = x.symbol AND e2.date = x.date LEFT JOIN b2 ON b2.symbol = x.symbol AND b2.date = x.date LEFT JOIN p2 ON p2.date = x.date LEFT JOIN h3 ON h3.symbol = x.symbol AND h3.date = x.date LEFT JOIN k3 ON k3.symbol = x.symbol AND k3.date = x.date
LEFT JOIN t_sector_map sm ON sm.symbol = x.symbol LEFT JOIN r2 ON r2.sector = sm.sector AND r2.date = x.date)
SELECT symbol, date, {', '.join(f'round({c}, 5) AS {c}' for c in _SMART)}, {', '.join(_SMART_FLAGS)} FROM y""", dates=("date",))
def smart_money_features(spark, sf):
    t = Tables(spark, sf)
    out = features.smart_money(t.days.select("symbol", "date"), t).withColumn("sector_rs_momentum", F.col("sector_rs_momentum").cast("double"))
    return S.rounded(out.select("symbol", "date", *_SMART, *_SMART_FLAGS), 5)


@query("cross_section_features", f"""WITH {_DAYS}, {_tables('sector_map')}, g AS (SELECT d.symbol, d.date, sector, (open - lag(close) OVER w) / lag(close) OVER w * 100 AS gap FROM d LEFT JOIN t_sector_map sm ON sm.symbol = d.symbol WINDOW w AS (PARTITION BY d.symbol ORDER BY d.date)),
m AS (SELECT a.symbol, a.date, a.gap, (SELECT quantile_cont(b.gap, 0.5) FROM g b WHERE b.date = a.date AND b.symbol <> a.symbol) AS mkt, CASE WHEN a.sector IS NOT NULL THEN (SELECT quantile_cont(b.gap, 0.5) FROM g b WHERE b.date = a.date AND b.sector = a.sector AND b.symbol <> a.symbol) END AS sec FROM g a)
SELECT symbol, date, round(gap, 5) AS gap_pct, round(mkt, 5) AS mkt_gap_median, round(gap - mkt, 5) AS gap_idiosyncratic, round(sec, 5) AS sector_gap_median, round(gap - sec, 5) AS gap_vs_sector FROM m""", dates=("date",))
def cross_section_features(spark, sf):
    t = Tables(spark, sf)
    frame = features.price_volume(t.days).select("symbol", "date", "gap_pct")
    return S.rounded(features.cross_section(frame, t.get("sector_map")).select("symbol", "date", "gap_pct", "mkt_gap_median", "gap_idiosyncratic", "sector_gap_median", "gap_vs_sector"), 5)


@query("assembled_features", f"""WITH {_DAYS}, {_tables('options', 'earnings_dates', 'fno_ban')}, {_series('nifty')}, n AS (SELECT date, lag(c) OVER (ORDER BY date) * 100 AS r FROM (SELECT date, value / lag(value) OVER (ORDER BY date) - 1 AS c FROM s_nifty)),
o AS (SELECT symbol, date, lag(pcr) OVER {_W} AS p FROM t_options) SELECT d.symbol, d.date, round((open - lag(close) OVER w) / lag(close) OVER w * 100, 5) AS gap_pct, round(n.r, 5) AS nifty_ret_1d, round(o.p, 5) AS opt_pcr, CAST((d.symbol, d.date) IN (SELECT (symbol, date) FROM t_earnings_dates) AS INTEGER) AS earnings_today,
CAST((d.symbol, d.date) IN (SELECT (symbol, date) FROM t_fno_ban) AS INTEGER) AS fno_ban_today FROM d LEFT JOIN n ON n.date = d.date LEFT JOIN o ON o.symbol = d.symbol AND o.date = d.date WINDOW w AS (PARTITION BY d.symbol ORDER BY d.date)""", dates=("date",))
def assembled_features(spark, sf):
    t = Tables(spark, sf)
    return S.rounded(features.assemble(t.days, t).select("symbol", "date", "gap_pct", "nifty_ret_1d", "opt_pcr", "earnings_today", "fno_ban_today"), 5)


#: Columns that the hypotheses need, as plain arithmetic on an order's figures.
_HYPOTHESIS_COLUMNS = {
    "gap_pct": "acctbal / 2000", "gap_dir": "sign(acctbal)", "delivery_z20": "qty / 50 - 1", "sector_rs_momentum": "disc - 0.05", "fii_fut_long_short": "qty / 60", "earnings_today": "CASE WHEN disc > 0.07 THEN 1 ELSE 0 END",
    "fno_ban_exit": "CASE WHEN n_items = 3 THEN 1 ELSE 0 END", "si_pctile_90d": "disc * 10", "bulk_deal_net5d": "qty - 100", "dist_prev_high": "acctbal - 2000", "gift_premium_pct": "CASE WHEN n_items > 1 THEN disc * 20 END",
    "zscore_20d": "acctbal / 300", "vix_pctile_1y": "disc * 10", "index_inclusion_window": "CASE WHEN n_items = 5 THEN 1 ELSE 0 END", "post_holiday": "CASE WHEN n_items = 6 THEN 1 ELSE 0 END",
    "fut_long_buildup": "CASE WHEN qty > 150 THEN 1 ELSE 0 END", "gap_idiosyncratic": "target * 2", "ret_1d": "target * 2", "pledge_chg_90d": "qty / 10", "usvix_ret_1d": "qty / 5",
}
#: What each hypothesis asks, and the sign of the return that it expects.
_HYPOTHESES = {
    "H01_delivery_gap_continuation": ("gap_pct > 0.5 AND delivery_z20 > 1 AND sector_rs_momentum > 0", "target"), "H02_fii_positioning_fade": ("gap_pct < -0.5 AND fii_fut_long_short > 1.5", "target"),
    "H03_earnings_gap_drift": ("earnings_today = 1 AND abs(gap_pct) > 1", "target * gap_dir"), "H04_ban_exit_squeeze": ("fno_ban_exit = 1", "target"), "H05_short_squeeze": ("gap_pct > 0.5 AND si_pctile_90d > 0.8", "target"),
    "H06_bulk_deal_breakout": ("bulk_deal_net5d > 0 AND dist_prev_high > 0", "target"), "H07_gap_overshoot_fade": ("abs(gap_pct - coalesce(gift_premium_pct, 0)) > 1.5", "-target"), "H08_high_vix_reversion": ("zscore_20d < -2 AND vix_pctile_1y > 0.7", "target"),
    "H09_index_inclusion_drift": ("index_inclusion_window = 1", "target"), "H10_post_holiday_gap_fade": ("post_holiday = 1 AND abs(gap_pct) > 0.75", "-target"), "H11_long_buildup_continuation": ("gap_pct > 0.5 AND fut_long_buildup = 1", "target"),
    "H12_idiosyncratic_gap_fade": ("abs(gap_idiosyncratic) > 1", "-target"), "H13_delivery_spike_reversal": ("delivery_z20 > 2 AND ret_1d < -1", "target"), "H14_pledge_distress_momentum": ("gap_pct < -0.5 AND pledge_chg_90d > 5", "-target"),
    "H15_global_riskoff_fade": ("gap_pct < -0.75 AND usvix_ret_1d > 10", "target"),
}


@query("all_hypotheses", f"""WITH {S.EVENTS_SQL}, g AS (SELECT date, target, {', '.join(f'{v} AS {k}' for k, v in _HYPOTHESIS_COLUMNS.items())} FROM e), m AS ({' UNION ALL '.join(f"SELECT '{n}' AS hypothesis, {y} AS ret, date FROM g WHERE {c}" for n, (c, y) in _HYPOTHESES.items())}),
f AS (SELECT hypothesis, count(*) FILTER (WHERE date <= DATE '1999-12-31') AS n_train, count(*) FILTER (WHERE date > DATE '1999-12-31') AS n_test, avg(ret) FILTER (WHERE date <= DATE '1999-12-31') AS a, avg(ret) FILTER (WHERE date > DATE '1999-12-31') AS b,
avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE date > DATE '1999-12-31') AS h FROM m GROUP BY 1)
SELECT hypothesis, n_train, n_test, CASE WHEN n_train >= 100 AND n_test >= 30 THEN 'tested' ELSE 'too few events' END AS status, round(a, 6) AS train_mean, round(b, 6) AS oos_mean, round(h, 6) AS oos_hit FROM f""")
def all_hypotheses(spark, sf):
    panel = S.order_events(spark, sf).selectExpr("date", "target", *(f"{v} AS {k}" for k, v in _HYPOTHESIS_COLUMNS.items()))
    out = hypotheses.run_hypotheses(panel, "target", T, p_values=False).filter("n_train + n_test > 0")
    return S.rounded(out.select("hypothesis", "n_train", "n_test", "status", "train_mean", "oos_mean", "oos_hit"))


@query("mechanical_actions", f"""WITH {_DAYS}, {_tables('corporate_actions')} SELECT symbol, date, count(*) AS n FROM t_corporate_actions WHERE type IN ('dividend', 'split') GROUP BY 1, 2""", dates=("date",))
def mechanical_actions(spark, sf):
    return audit.mechanical(Tables(spark, sf).get("corporate_actions")).groupBy("symbol", "date").agg(F.count("*").alias("n"))


#: The kinds of events, each a symbol with a file of bars.
_SYMBOLS = ("click", "error", "purchase", "signup", "view")


def _market_folder(spark, sf: str) -> str:
    """Orders and events laid down as a market folder: bars by symbol, daily series, keyed tables. Rebuilt for each call, on Spark's own file system."""
    from tidemark.session import work_folder

    t, root = Tables(spark, sf), work_folder(spark, "market")
    bars = S.event_bars(spark, sf).select("symbol", F.col("ts").alias("Timestamp"), F.col("open").alias("Open"), F.col("high").alias("High"), F.col("low").alias("Low"), F.col("close").alias("Close"), F.col("volume").cast("string").alias("Volume"))
    for symbol in _SYMBOLS:
        sinks.write_parquet(bars.filter(F.col("symbol") == symbol).drop("symbol"), f"{root}/minute_bars/{symbol}.parquet")
    sinks.write_parquet(t.get("nifty").select(F.col("ts").cast("timestamp").alias("Date"), F.col("value").alias("Close"), F.lit("x").alias("note")), f"{root}/nifty.parquet")
    sinks.write_parquet(t.get("sector_map"), f"{root}/sector_map.parquet")
    sinks.write_parquet(t.get("earnings_dates").select("symbol", F.col("date").cast("string").alias("Date")), f"{root}/earnings_dates.parquet")
    universe = t.get("earnings_dates").select("symbol", F.col("date").cast("string").alias("from_date"), F.lit(None).cast("string").alias("to_date"))
    sinks.write_parquet(universe, f"{root}/fno_universe.parquet")
    sinks.write_parquet(t.days.filter("symbol = 'BUILDING'").select(F.col("date").cast("timestamp").alias("datetime"), F.col("volume").alias("IV")), f"{root}/options/BUILDING.parquet")
    sinks.write_csv(t.days.groupBy("symbol").agg(F.max("close").alias("top"), F.collect_set("symbol").alias("names")), f"{root}/result")
    return root


@query("source_minute_bars", f"WITH {S.BARS_SQL} SELECT symbol, date_trunc('month', ts) AS month, count(*) AS n, round(sum(close), 4) AS closes, sum(volume) AS volume FROM b GROUP BY 1, 2", dates=("month",))
def source_minute_bars(spark, sf):
    found = readers.minute_bars(spark, _market_folder(spark, sf))
    return S.rounded(found.groupBy("symbol", F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month")).agg(F.count("*").alias("n"), F.sum("close").alias("closes"), F.sum("volume").alias("volume")), 4)


@query("source_daily_series", f"WITH {_DAYS}, {_series('nifty')} SELECT date, value FROM s_nifty", dates=("date",))
def source_daily_series(spark, sf):
    return readers.daily_series(spark, _market_folder(spark, sf), "nifty").select(F.to_date("ts").alias("date"), "value")


@query("source_tables", f"""WITH {_DAYS}, {_tables('earnings_dates', 'sector_map')} SELECT 'earnings' AS source, symbol, count(*) AS n, CAST(min(date) AS VARCHAR) AS first FROM t_earnings_dates GROUP BY 2 UNION ALL SELECT 'sector ' || sector, symbol, 1, NULL FROM t_sector_map
UNION ALL SELECT 'options', 'BUILDING', count(*), CAST(min(date) AS VARCHAR) FROM d WHERE symbol = 'BUILDING' UNION ALL SELECT 'universe', symbol, count(*), CAST(min(date) AS VARCHAR) FROM t_earnings_dates GROUP BY 2
UNION ALL SELECT DISTINCT 'symbols', event_type, 1, NULL FROM events UNION ALL SELECT 'csv', symbol, CAST(round(max(close)) AS BIGINT), symbol FROM d GROUP BY 2""")
def source_tables(spark, sf):
    root = _market_folder(spark, sf)
    reg = readers.Registry(spark, root)
    first = F.min("date").cast("string").alias("first")
    parts = [
        reg.get("earnings_dates").groupBy("symbol").agg(F.count("*").alias("n"), first).select(F.lit("earnings").alias("source"), "symbol", "n", "first"),
        reg.get("sector_map").select(F.concat(F.lit("sector "), "sector").alias("source"), "symbol", F.lit(1).cast("long").alias("n"), F.lit(None).cast("string").alias("first")),
        reg.get("options").groupBy("symbol").agg(F.count("iv").alias("n"), first).select(F.lit("options").alias("source"), "symbol", "n", "first"),
        readers.universe(spark, root).filter("to_date IS NULL").groupBy("symbol").agg(F.count("*").alias("n"), F.min("from_date").cast("string").alias("first")).select(F.lit("universe").alias("source"), "symbol", "n", "first"),
        readers.discover_symbols(spark, root).select(F.lit("symbols").alias("source"), "symbol", F.lit(1).cast("long").alias("n"), F.lit(None).cast("string").alias("first")),
        readers.result_csv(spark, f"{root}/result").select(F.lit("csv").alias("source"), "symbol", F.round("top").cast("long").alias("n"), F.get(F.from_json("names", "array<string>"), F.lit(0)).alias("first")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
