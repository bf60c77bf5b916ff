"""Queries over the driver's tables, one or more for each operator family, with their SQL twins."""

from __future__ import annotations


from pyspark.sql import functions as F

from tidemark.functions.columns import carried, flag, pct_change_of, pct_rank, rolling_pct_rank, series
from tidemark.operators import audit, bars, costs, features, joins, labels, microstructure, stats
from tidemark.plans import samples as S

QUERIES: dict = {}
SQL: dict[str, str] = {}
T = S.SAMPLE_SETTINGS


def query(name: str, sql: str | None = None, dates: tuple[str, ...] = ()):
    """Register a query and its twin; dates: columns that both give as text."""

    def note(f):
        QUERIES[name] = (lambda spark, sf: f(spark, sf).withColumns({c: F.col(c).cast("string") for c in dates})) if dates else f
        if sql:
            SQL[name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in dates)}) FROM ({sql})" if dates else sql
        return f

    return note


@query("daily_bars", f"""WITH {S.BARS_SQL} SELECT symbol, date, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM b GROUP BY symbol, date""", dates=("date",))
def daily_bars(spark, sf):
    return bars.to_daily(S.event_bars(spark, sf))


@query("hourly_bars", """SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, CAST(count(value) AS DOUBLE) AS volume
FROM events GROUP BY 1, 2""", dates=("ts",))
def hourly_bars(spark, sf):
    (ev,) = S.tables(spark, sf, "events")
    return bars.ticks_to_bars(ev.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("price")), "hour").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("open_window_volume", f"""WITH {S.BARS_SQL} SELECT symbol, date, coalesce(sum(volume) FILTER (WHERE strftime(ts, '%H:%M') BETWEEN '09:15' AND '09:45'), 0.0) AS open_volume,
round(sum(volume * close) FILTER (WHERE strftime(ts, '%H:%M') BETWEEN '09:15' AND '09:45'), 4) AS open_value FROM b GROUP BY symbol, date""", dates=("date",))
def open_window_volume(spark, sf):
    return S.rounded(bars.open_window(S.event_bars(spark, sf)), 4)


@query("between_time", f"""WITH {S.BARS_SQL} SELECT symbol, count(*) AS n FROM b WHERE strftime(ts, '%H:%M') BETWEEN '10:00' AND '11:30' GROUP BY symbol""")
def between_time(spark, sf):
    return bars.between_time(S.event_bars(spark, sf), "10:00", "11:30").groupBy("symbol").agg(F.count("*").alias("n"))


@query("resample_last", """SELECT CAST(ts AS DATE) AS date, arg_max(value, ts) AS value FROM events WHERE event_type = 'view' AND value IS NOT NULL GROUP BY 1""", dates=("date",))
def resample_last(spark, sf):
    (ev,) = S.tables(spark, sf, "events")
    return bars.last_per_day(ev.filter("event_type = 'view'").select("ts", "value"))


@query("price_volume_features", f"""WITH {S.DAYS_SQL},
a AS (SELECT *, lag(close) OVER w AS pc, lag(close, 2) OVER w AS pc2, lag(close, 6) OVER w AS pc6, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(volume) OVER w AS pv, row_number() OVER w AS k FROM d WINDOW w AS (PARTITION BY symbol ORDER BY date)),
t AS (SELECT *, (open - pc) / pc * 100 AS gap, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr, close / pc - 1 AS chg, (high - low) / close * 100 AS rng, CASE WHEN close > pc THEN 1 ELSE 0 END AS up FROM a),
r AS (SELECT *, CASE WHEN count(tr) OVER w14 = 14 THEN avg(tr) OVER w14 END / close AS atr, sum(CASE WHEN lagup IS NULL OR lagup <> up THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY date) AS run,
      CASE WHEN count(chg) OVER w20 = 20 THEN stddev_samp(chg) OVER w20 END AS sd20, CASE WHEN count(rng) OVER w5 = 5 THEN avg(rng) OVER w5 END AS r5, CASE WHEN count(rng) OVER w60 = 60 THEN avg(rng) OVER w60 END AS r60,
      CASE WHEN count(volume) OVER v20 = 20 THEN avg(volume) OVER v20 END AS v20, CASE WHEN count(close) OVER w20 = 20 THEN avg(close) OVER w20 END AS m20, CASE WHEN count(close) OVER w20 = 20 THEN stddev_samp(close) OVER w20 END AS s20,
      CASE WHEN count(high) OVER w252 = 252 THEN max(high) OVER w252 END AS hi, CASE WHEN count(low) OVER w252 = 252 THEN min(low) OVER w252 END AS lo
      FROM (SELECT *, lag(up) OVER (PARTITION BY symbol ORDER BY date) AS lagup FROM t)
      WINDOW w14 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), w20 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
      w5 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), w60 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING),
      v20 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 21 PRECEDING AND 2 PRECEDING), w252 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, sum(up) OVER (PARTITION BY symbol, run ORDER BY date) AS streak FROM r)
SELECT symbol, date, round(gap, 6) AS gap_pct, CAST(sign(gap) AS DOUBLE) AS gap_dir, round(lag(chg) OVER w * 100, 6) AS ret_1d, round((pc / pc6 - 1) * 100, 6) AS ret_5d, round(lag(atr) OVER w * 100, 6) AS atr14_pct,
       round(sd20 * sqrt(252.0) * 100, 6) AS rv20, round(abs(gap) / nullif(lag(atr) OVER w * 100, 0), 6) AS gap_vs_atr, round(r5 / nullif(r60, 0), 6) AS range_compression, round(pv / nullif(v20, 0), 6) AS rvol_20d,
       round((open - ph) / pc * 100, 6) AS dist_prev_high, round((open - pl) / pc * 100, 6) AS dist_prev_low, round(open / hi - 1, 6) AS dist_52w_high, round(open / lo - 1, 6) AS dist_52w_low,
       CAST(lag(streak) OVER w AS BIGINT) AS up_streak, round((open - m20) / nullif(s20, 0), 6) AS zscore_20d, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CASE WHEN day(date) >= 28 THEN 1 ELSE 0 END AS is_month_end
FROM s WINDOW w AS (PARTITION BY symbol ORDER BY date)""", dates=("date",))
def price_volume_features(spark, sf):
    names = "gap_pct gap_dir ret_1d ret_5d atr14_pct rv20 gap_vs_atr range_compression rvol_20d dist_prev_high dist_prev_low dist_52w_high dist_52w_low up_streak zscore_20d day_of_week is_month_end".split()
    return S.rounded(features.price_volume(S.order_days(spark, sf)).select("symbol", "date", *names))


@query("rolling_pct_rank", f"""WITH {S.DAYS_SQL}, v AS (SELECT symbol, date, close, list(close) OVER w AS xs, count(close) OVER w AS n FROM d WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
SELECT symbol, date, CASE WHEN n = 60 THEN round((len(list_filter(xs, lambda x: x < close)) + (len(list_filter(xs, lambda x: x = close)) + 1) / 2.0) / 60, 6) END AS r FROM v""", dates=("date",))
def rolling_rank(spark, sf):
    return S.rounded(S.order_days(spark, sf).select("symbol", "date", rolling_pct_rank(F.col("close"), series(), 60).alias("r")))


@query("pct_rank", f"""WITH {S.EVENTS_SQL}, k AS (SELECT symbol, event_id, qty, rank() OVER (PARTITION BY symbol ORDER BY qty) AS r, count(*) OVER (PARTITION BY symbol, qty) AS ties, count(qty) OVER (PARTITION BY symbol) AS n FROM e WHERE qty IS NOT NULL)
SELECT symbol, event_id, round((r + (ties - 1) / 2.0) / n, 6) AS r FROM k""")
def percentile_rank(spark, sf):
    return S.rounded(S.order_events(spark, sf).select("symbol", "event_id", pct_rank(F.col("qty"), ["symbol"]).alias("r")))


@query("pct_change_padded", f"""WITH {S.DAYS_SQL}, h AS (SELECT symbol, date, CASE WHEN day(date) % 5 <> 0 THEN close END AS x FROM d),
f AS (SELECT *, last_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y FROM h)
SELECT symbol, date, round(y / lag(y) OVER (PARTITION BY symbol ORDER BY date) - 1, 6) AS c FROM f""", dates=("date",))
def pct_change_padded(spark, sf):
    w = series()
    d = S.order_days(spark, sf).withColumn("x", F.when(F.day("date") % 5 != 0, F.col("close"))).withColumn("y", carried(F.col("x"), w))
    return S.rounded(d.select("symbol", "date", pct_change_of(F.col("y"), w).alias("c")))


@query("asof_backward", f"""WITH {S.DAYS_SQL}, s AS (SELECT date, close AS value FROM d WHERE symbol = 'BUILDING' AND day(date) % 3 = 0)
SELECT l.symbol, l.date, s.value FROM d l ASOF LEFT JOIN s ON l.date >= s.date""", dates=("date",))
def asof_backward(spark, sf):
    d = S.order_days(spark, sf)
    s = d.filter("symbol = 'BUILDING' AND day(date) % 3 = 0").select("date", F.col("close").alias("value"))
    return joins.asof(d.select("symbol", "date"), s, ["value"])


@query("asof_strict", f"""WITH {S.DAYS_SQL}, s AS (SELECT symbol, date, close AS value FROM d WHERE day(date) % 4 = 0)
SELECT l.symbol, l.date, s.value FROM d l ASOF LEFT JOIN s ON l.symbol = s.symbol AND l.date > s.date""", dates=("date",))
def asof_strict(spark, sf):
    d = S.order_days(spark, sf)
    s = d.filter("day(date) % 4 = 0").select("symbol", "date", F.col("close").alias("value"))
    return joins.asof(d.select("symbol", "date"), s, ["value"], by=["symbol"], strict=True)


@query("membership_flag", f"""WITH {S.DAYS_SQL}, k AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_totalprice > 400000)
SELECT symbol, date, CASE WHEN date IN (SELECT date FROM k) THEN 1 ELSE 0 END AS big_day FROM d""", dates=("date",))
def membership_flag(spark, sf):
    (o,) = S.tables(spark, sf, "orders")
    keys = o.filter("o_totalprice > 400000").select(F.to_date("o_orderdate").alias("date"))
    return joins.member_flag(S.order_days(spark, sf), keys, ["date"], "big_day").select("symbol", "date", "big_day")


@query("band_window_flag", f"""WITH {S.DAYS_SQL}, k AS (SELECT symbol, date FROM d0 WHERE o_totalprice > 440000)
SELECT symbol, date, CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.symbol = d.symbol AND abs(date_diff('day', k.date, d.date)) <= 10) THEN 1 ELSE 0 END AS near FROM d""", dates=("date",))
def band_window_flag(spark, sf):
    o, c = S.tables(spark, sf, "orders", "customer")
    k = o.filter("o_totalprice > 440000").join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("c_mktsegment").alias("symbol"), F.to_date("o_orderdate").alias("date"))
    return joins.near_flag(S.order_days(spark, sf), k, 10, ["symbol"], "near").select("symbol", "date", "near")


_UNIVERSE = """u AS (SELECT c_mktsegment AS symbol, DATE '1995-01-01' + CAST(c_custkey % 300 * 7 AS INTEGER) AS from_date, CASE WHEN c_custkey % 297 <> 296 THEN DATE '1995-01-01' + CAST(c_custkey % 300 * 7 AS INTEGER) + 3 END AS to_date
FROM customer)"""


def _universe(spark, sf):
    (c,) = S.tables(spark, sf, "customer")
    start = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") % 300 * 7).cast("int"))
    return c.select(F.col("c_mktsegment").alias("symbol"), start.alias("from_date"), F.when(F.col("c_custkey") % 297 != 296, F.date_add(start, 3)).alias("to_date"))


@query("universe_range_semi", f"""WITH {S.DAYS_SQL}, {_UNIVERSE} SELECT symbol, date FROM d WHERE EXISTS (SELECT 1 FROM u WHERE u.symbol = d.symbol AND d.date >= u.from_date AND d.date <= coalesce(u.to_date, DATE '9999-12-31'))""", dates=("date",))
def universe_range_semi(spark, sf):
    return joins.in_universe(S.order_days(spark, sf).select("symbol", "date"), _universe(spark, sf))


@query("quarantine_anti", f"""WITH {S.DAYS_SQL} SELECT symbol, date FROM d WHERE NOT EXISTS (SELECT 1 FROM d q WHERE q.symbol = d.symbol AND q.date = d.date AND q.volume = 1)""", dates=("date",))
def quarantine_anti(spark, sf):
    d = S.order_days(spark, sf).select("symbol", "date", "volume")
    return audit.apply_quarantine(d.drop("volume"), d.filter("volume = 1"))


@query("densify_business_days", f"""WITH {S.DAYS_SQL}, s AS (SELECT symbol, min(date) AS a, max(date) AS z FROM d WHERE day(date) <= 20 GROUP BY symbol), g AS (SELECT symbol, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS date FROM s)
SELECT g.symbol, g.date, coalesce(d.volume, 0.0) AS volume FROM g LEFT JOIN (SELECT * FROM d WHERE day(date) <= 20) d ON d.symbol = g.symbol AND d.date = g.date WHERE isodow(g.date) < 6""", dates=("date",))
def densify_business_days(spark, sf):
    return joins.densify(S.order_days(spark, sf).filter("day(date) <= 20").select("symbol", "date", "volume"), ["symbol"], business=True, fill={"volume": 0.0})


_LOO = """SELECT a.symbol, a.date, (SELECT quantile_cont(b.close, 0.5) FROM {t} b WHERE b.date = a.date {more} AND b.symbol <> a.symbol) AS others FROM {t} a"""


@query("loo_median_market", f"WITH {S.DAYS_SQL} " + _LOO.format(t="d", more=""), dates=("date",))
def loo_median_market(spark, sf):
    return joins.leave_one_out_median(S.order_days(spark, sf), ["date"], "close", "others").select("symbol", "date", "others")


@query("loo_median_sector", """WITH n AS (SELECT n_name AS symbol, n_regionkey AS sector, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, max(o_totalprice) AS close FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)
SELECT a.symbol, a.date, (SELECT quantile_cont(b.close, 0.5) FROM n b WHERE b.date = a.date AND b.sector = a.sector AND b.symbol <> a.symbol) AS others FROM n a""", dates=("date",))
def loo_median_sector(spark, sf):
    o, c, n = S.tables(spark, sf, "orders", "customer", "nation")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # nation: a fixed list
    rows = rows.groupBy(F.col("n_name").alias("symbol"), F.col("n_regionkey").alias("sector"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("date")).agg(F.max("o_totalprice").alias("close"))
    return joins.leave_one_out_median(rows, ["date", "sector"], "close", "others").select("symbol", "date", "others")


_ACTIONS = "act AS (SELECT c_mktsegment AS symbol, DATE '1995-01-01' + CAST(c_custkey % 2300 AS INTEGER) AS date FROM customer WHERE c_custkey % 3 = 0)"


def _actions(spark, sf):
    (c,) = S.tables(spark, sf, "customer")
    kind = F.when(F.col("c_custkey") % 3 == 0, "Stock Split").otherwise("meeting")
    return c.select(F.col("c_mktsegment").alias("symbol"), F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") % 2300).cast("int")).alias("date"), kind.alias("type"))


@query("audit_checks", f"""WITH {S.DAYS_SQL}, {_ACTIONS}, j AS (SELECT *, (open - lag(close) OVER w) / lag(close) OVER w * 100 AS jump_pct, lag(volume) OVER w AS pv FROM d WINDOW w AS (PARTITION BY symbol ORDER BY date))
SELECT symbol, date, round(jump_pct, 6) AS jump_pct, CASE WHEN EXISTS (SELECT 1 FROM act WHERE act.symbol = j.symbol AND abs(date_diff('day', act.date, j.date)) <= 1) THEN 1 ELSE 0 END AS explained FROM j WHERE abs(jump_pct) > 300""", dates=("date",))
def audit_checks(spark, sf):
    return S.rounded(audit.checks(S.order_days(spark, sf), _actions(spark, sf), T).filter("jump").select("symbol", "date", "jump_pct", "explained"))


@query("stale_runs", f"""WITH {S.DAYS_SQL}, j AS (SELECT symbol, date, volume, CASE WHEN volume = lag(volume) OVER w THEN 1 ELSE 0 END AS same FROM d WINDOW w AS (PARTITION BY symbol ORDER BY date)),
r AS (SELECT *, sum(1 - same) OVER (PARTITION BY symbol ORDER BY date) AS run FROM j) SELECT symbol, date, CAST(sum(same) OVER (PARTITION BY symbol, run ORDER BY date) AS BIGINT) AS flat_days FROM r""", dates=("date",))
def stale_runs(spark, sf):
    return audit.checks(S.order_days(spark, sf).withColumn("close", F.col("volume")), None, T).select("symbol", "date", "flat_days")


@query("audit_issues", f"""WITH {S.DAYS_SQL}, j AS (SELECT symbol, (open - lag(close) OVER w) / lag(close) OVER w * 100 AS jump_pct FROM d WINDOW w AS (PARTITION BY symbol ORDER BY date))
SELECT 'CRITICAL' AS severity, count(*) + 1 AS n FROM j WHERE abs(jump_pct) > 300 UNION ALL SELECT 'warning', count(*) FROM (SELECT symbol FROM d GROUP BY symbol HAVING count(*) < 250) HAVING count(*) > 0""")
def audit_issues(spark, sf):
    return audit.by_severity(audit.issues(audit.checks(S.order_days(spark, sf), None, T).withColumn("stale", F.lit(False)), universe_known=False, s=T))


_COST = "0.032 + (0.03 + 0.1 * sqrt(least(1000000.0 / greatest(open30_value, 1.0), 1.0)) * 100) * 2.0 + 0.02 * abs(target)"


@query("cost_model", f"WITH {S.EVENTS_SQL} SELECT event_id, round({_COST}, 9) AS cost_pct FROM e")
def cost_model(spark, sf):
    e = S.order_events(spark, sf).withColumn("gap_pct", F.col("target"))
    return S.rounded(costs.with_event_costs(e, "gap").select("event_id", "cost_pct"), 9)


@query("cost_summary", f"WITH {S.EVENTS_SQL}, c AS (SELECT symbol, {_COST.replace('1000000.0', '100000.0')} AS c FROM e) SELECT symbol, round(avg(c), 4) AS cost_mean, round(quantile_cont(c, 0.9), 4) AS cost_p90, round(max(c), 4) AS cost_max FROM c GROUP BY symbol")
def cost_summary(spark, sf):
    from dataclasses import replace

    e = S.order_events(spark, sf)
    c = costs.trade_cost_pct(F.col("open30_value"), True, F.col("target"), replace(T, trade_value=100000.0))
    return costs.cost_summary(e.withColumn("cost_pct", c), ["symbol"])


_NUM = "n AS (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol, date) AS bars FROM b)"
_BARRIER = """en AS (SELECT x.*, c.close AS p0, c.close * (1 + dir * 2.0 * atr / 100) AS up, c.close * (1 - dir * 1.0 * atr / 100) AS dn FROM x JOIN n c ON c.symbol = x.symbol AND c.date = x.date AND c.i = x.entry),
pa AS (SELECT en.symbol, en.date, min(n.i) FILTER (WHERE CASE WHEN dir > 0 THEN high >= up ELSE low <= up END) AS w, min(n.i) FILTER (WHERE CASE WHEN dir > 0 THEN low <= dn ELSE high >= dn END) AS l, arg_max(n.close, n.i) AS px
       FROM en JOIN n ON n.symbol = en.symbol AND n.date = en.date AND n.i > en.entry AND n.i <= en.entry + 20 GROUP BY 1, 2),
tb AS (SELECT en.symbol, en.date, CASE WHEN px IS NULL THEN NULL WHEN l IS NOT NULL AND (w IS NULL OR l <= w) THEN -1 WHEN w IS NOT NULL THEN 1 ELSE 0 END AS tb_hit,
       CASE WHEN px IS NULL THEN NULL WHEN l IS NOT NULL AND (w IS NULL OR l <= w) THEN -1.0 * atr WHEN w IS NOT NULL THEN 2.0 * atr ELSE dir * (px - p0) / p0 * 100 END AS tb_ret FROM en LEFT JOIN pa ON pa.symbol = en.symbol AND pa.date = en.date)"""


def _gaps(spark, sf):
    d = bars.to_daily(S.event_bars(spark, sf))
    before = F.lag("close").over(series())
    return d.select("symbol", "date", ((F.col("open") - before) / before * 100).alias("gap_pct"))


@query("gap_go_labels", f"""WITH {S.BARS_SQL}, {_NUM}, dd AS (SELECT symbol, date, arg_min(open, ts) AS o, arg_max(close, ts) AS c FROM b GROUP BY 1, 2),
g AS (SELECT * FROM (SELECT symbol, date, (o - lag(c) OVER w) / lag(c) OVER w * 100 AS gap FROM dd WINDOW w AS (PARTITION BY symbol ORDER BY date)) WHERE abs(gap) >= 5),
f AS (SELECT g.symbol, g.date, gap, arg_min(open, i) AS o, arg_max(close, i) AS c, arg_max(close, i) FILTER (WHERE i < 5) AS c5, arg_max(close, i) FILTER (WHERE i < 15) AS c15, arg_max(close, i) FILTER (WHERE i < 30) AS c30 FROM g JOIN n ON n.symbol = g.symbol AND n.date = g.date AND bars >= 5 GROUP BY 1, 2, 3),
x AS (SELECT f.symbol, f.date, 0 AS entry, sign(gap) AS dir, greatest(avg((high - low) / close * 100) * 10, 0.3) AS atr FROM f JOIN n ON n.symbol = f.symbol AND n.date = f.date AND i < 5 GROUP BY f.symbol, f.date, gap),
{_BARRIER}
SELECT f.symbol, f.date, round(gap, 6) AS gap_pct, round(sign(gap) * (c5 - o) / o * 100, 6) AS cont_5m, round(sign(gap) * (c30 - o) / o * 100, 6) AS cont_30m, CASE WHEN sign(gap) * (c15 - o) > 0 THEN 1 ELSE 0 END AS go_15m,
       round(sign(gap) * (c - o) / o * 100, 6) AS cont_close, (SELECT CAST(max(CASE WHEN low <= o / (1 + gap / 100) AND high >= o / (1 + gap / 100) THEN 1 ELSE 0 END) AS INTEGER) FROM n WHERE n.symbol = f.symbol AND n.date = f.date) AS filled_gap,
       tb_hit, round(tb_ret, 6) AS tb_ret FROM f JOIN tb ON tb.symbol = f.symbol AND tb.date = f.date""", dates=("date",))
def gap_go_labels(spark, sf):
    out = labels.gap_go(S.event_bars(spark, sf), _gaps(spark, sf), T, start=None)
    return S.rounded(out.select("symbol", "date", "gap_pct", "cont_5m", "cont_30m", "go_15m", "cont_close", "filled_gap", "tb_hit", "tb_ret"))


@query("mean_reversion_labels", f"""WITH {S.BARS_SQL}, {_NUM},
v AS (SELECT *, sum((high + low + close) / 3 * volume) OVER w / nullif(sum(volume) OVER w, 0) AS vwap FROM n WHERE bars >= 30 WINDOW w AS (PARTITION BY symbol, date ORDER BY i)),
z AS (SELECT *, CASE WHEN count(dev) OVER w >= 12 THEN dev / nullif(stddev_samp(dev) OVER w, 0) END AS z FROM (SELECT *, close - vwap AS dev FROM v) WINDOW w AS (PARTITION BY symbol, date ORDER BY i)),
t AS (SELECT symbol, date, min(i) AS i FROM z WHERE abs(z) >= 1.5 GROUP BY 1, 2),
p AS (SELECT z.symbol, z.date, z.i AS entry, -sign(z.dev) AS dir, z.z AS mr_z, strftime(z.ts, '%H:%M') AS mr_time, z.close AS p, z.bars FROM t JOIN z ON z.symbol = t.symbol AND z.date = t.date AND z.i = t.i WHERE z.i >= 12 AND z.i <= z.bars - 10),
x AS (SELECT p.symbol, p.date, p.entry, p.dir, greatest(avg((high - low) / close * 100) * 10, 0.3) AS atr FROM p JOIN n ON n.symbol = p.symbol AND n.date = p.date AND n.i < greatest(p.entry, 5) GROUP BY 1, 2, 3, 4),
{_BARRIER}
SELECT p.symbol, p.date, round(mr_z, 6) AS mr_z, mr_time, round(dir * (a.close - p) / p * 100, 6) AS revert_3m, round(dir * (c.close - p) / p * 100, 6) AS revert_10m, CASE WHEN dir * (a.close - p) > 0 THEN 1 ELSE 0 END AS rev_3m, tb_hit, round(tb_ret, 6) AS tb_ret
FROM p JOIN n a ON a.symbol = p.symbol AND a.date = p.date AND a.i = least(entry + 3, p.bars - 1) JOIN n c ON c.symbol = p.symbol AND c.date = p.date AND c.i = least(entry + 10, p.bars - 1) JOIN tb ON tb.symbol = p.symbol AND tb.date = p.date""", dates=("date",))
def mean_reversion_labels(spark, sf):
    out = labels.mean_reversion(S.event_bars(spark, sf), T, start=None, least_bars=30, warm_up=12)
    return S.rounded(out.select("symbol", "date", "mr_z", "mr_time", "revert_3m", "revert_10m", "rev_3m", "tb_hit", "tb_ret"))


_CDF = "CASE WHEN x >= 0 THEN 1 - u ELSE u END"


@query("microstructure", f"""WITH {S.BARS_SQL}, c AS (SELECT *, count(*) OVER (PARTITION BY symbol, date) AS bars FROM b),
m AS (SELECT *, close / lag(close) OVER w - 1 AS ret, close - lag(close) OVER w AS dp FROM c WHERE bars >= 30 WINDOW w AS (PARTITION BY symbol, date ORDER BY ts)),
x AS (SELECT *, coalesce(last_value(nullif(sign(ret), 0) IGNORE NULLS) OVER (PARTITION BY symbol, date ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) * sqrt(greatest(close * volume, 0)) AS x, lag(dp) OVER w AS dp1,
      stddev_samp(ret) OVER (PARTITION BY symbol, date) AS sd, sum(volume) OVER w AS cum, sum(volume) OVER (PARTITION BY symbol, date) AS tot, nullif(sign(dp), 0) AS dir FROM m WINDOW w AS (PARTITION BY symbol, date ORDER BY ts)),
g AS (SELECT symbol, date, avg(abs(ret) / nullif(close * volume, 0)) * 1e9 AS ms_amihud, CASE WHEN count(*) FILTER (WHERE x <> 0 AND ret IS NOT NULL) >= 20 THEN sum(x * abs(ret)) FILTER (WHERE x <> 0 AND ret IS NOT NULL) / sum(x * x) FILTER (WHERE x <> 0 AND ret IS NOT NULL) * 1e6 END AS ms_kyle_lambda,
      CASE WHEN count(dp) < 20 THEN NULL WHEN covar_samp(dp, dp1) >= 0 THEN 0 ELSE 2 * sqrt(greatest(-covar_samp(dp, dp1), 0)) / quantile_cont(close, 0.5) * 100 END AS ms_roll_spread,
      coalesce(sum(((close - low) - (high - close)) / nullif(high - low, 0) * volume), 0) / sum(volume) AS ms_clv_pressure FROM x GROUP BY 1, 2),
q AS (SELECT symbol, date, volume, cum, tot, greatest(-6, least(6, ret / sd)) AS x FROM x WHERE sd > 0),
k AS (SELECT *, 1 / (1 + 0.2316419 * abs(x)) AS t FROM q),
u AS (SELECT *, 0.3989422804014327 * exp(-x * x / 2) * (((((1.330274429 * t - 1.821255978) * t + 1.781477937) * t - 0.356563782) * t + 0.319381530) * t) AS u FROM k),
h AS (SELECT symbol, date, least(floor(cum / tot * 20), 19) AS k, sum(volume) AS v, sum(coalesce({_CDF}, 0.5) * volume) AS by_ FROM u GROUP BY 1, 2, 3),
vp AS (SELECT symbol, date, avg(abs(2 * by_ - v) / v) AS ms_vpin FROM h GROUP BY 1, 2),
mv AS (SELECT *, CASE WHEN dir = lag(dir) OVER (PARTITION BY symbol, date ORDER BY ts) THEN 0 ELSE 1 END AS new FROM x WHERE dir IS NOT NULL),
rn AS (SELECT symbol, date, run, count(*) AS len FROM (SELECT *, sum(new) OVER (PARTITION BY symbol, date ORDER BY ts) AS run FROM mv) GROUP BY 1, 2, 3),
ln_ AS (SELECT symbol, date, len, count(*) AS n FROM rn GROUP BY 1, 2, 3),
en AS (SELECT symbol, date, CASE WHEN sum(len * n) >= 20 THEN -sum(s * log2(s)) END AS ms_run_entropy FROM (SELECT *, n / sum(n) OVER (PARTITION BY symbol, date) AS s FROM ln_) GROUP BY 1, 2)
SELECT g.symbol, g.date, round(ms_amihud, 2) AS ms_amihud, round(ms_kyle_lambda, 4) AS ms_kyle_lambda, round(ms_roll_spread, 5) AS ms_roll_spread, round(ms_vpin, 6) AS ms_vpin, round(ms_clv_pressure, 6) AS ms_clv_pressure, round(ms_run_entropy, 6) AS ms_run_entropy
FROM g LEFT JOIN vp ON vp.symbol = g.symbol AND vp.date = g.date LEFT JOIN en ON en.symbol = g.symbol AND en.date = g.date""", dates=("date",))
def micro(spark, sf):
    return S.rounded(microstructure.daily_measures(S.event_bars(spark, sf), 30, 20, ieee=True), ms_amihud=2, ms_kyle_lambda=4, ms_roll_spread=5)


_KISH = """kd AS (SELECT symbol, date, count(*) AS n, sum(target) AS s, sum(target * target) AS q FROM e GROUP BY 1, 2),
ks AS (SELECT symbol, CAST(sum(n) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS days, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM kd GROUP BY 1),
kc AS (SELECT *, q - s * s / n AS total, b - s * s / n AS between_, n / days AS bar FROM ks),
kn AS (SELECT symbol, CASE WHEN n < 30 OR bar <= 1.5 OR total <= 0 THEN n ELSE greatest(least(n / (1 + (bar - 1) * greatest(0.0, least(0.99, (between_ / total - 1 / bar) / (1 - 1 / bar)))), n), days) END AS n_eff FROM kc)"""


@query("kish_effective_n", f"WITH {S.EVENTS_SQL}, {_KISH} SELECT symbol, round(n_eff, 4) AS n_eff FROM kn")
def kish(spark, sf):
    return S.rounded(stats.effective_n(S.order_events(spark, sf), ["symbol"], "target"), 4)


@query("edge_metrics", f"""WITH {S.EVENTS_SQL}, {_KISH} SELECT e.symbol, count(*) AS n, round(any_value(n_eff), 1) AS n_eff, round(avg(target), 6) AS mean_ret, round(quantile_cont(target, 0.5), 6) AS median_ret, round(avg(CASE WHEN target > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate,
round(avg(target) / (stddev_samp(target) / sqrt(any_value(n_eff))), 5) AS t_stat, round(avg(target) / stddev_samp(target) * sqrt(252.0), 5) AS sharpe_like, round(sum(target) FILTER (WHERE target > 0) / -sum(target) FILTER (WHERE target < 0), 5) AS profit_factor
FROM e JOIN kn ON e.symbol = kn.symbol GROUP BY e.symbol""")
def edge_metrics(spark, sf):
    out = stats.edge_metrics(S.order_events(spark, sf), ["symbol"], "target", p_values=False).drop("p_value")
    return S.rounded(out, t_stat=5, sharpe_like=5, profit_factor=5)


_LONG = "l AS (SELECT date, target AS ret, 'acctbal' AS factor, acctbal AS x FROM e UNION ALL SELECT date, target, 'qty', qty FROM e UNION ALL SELECT date, target, 'disc', disc FROM e UNION ALL SELECT date, target, 'n_items', n_items FROM e)"
_BUCKETS = """ed AS (SELECT factor, list_sort(list_distinct([quantile_cont(x, 0.0), quantile_cont(x, 0.2), quantile_cont(x, 0.4), quantile_cont(x, 0.6), quantile_cont(x, 0.8), quantile_cont(x, 1.0)])) AS edges FROM {t} GROUP BY factor),
bm AS (SELECT {t}.*, edges, greatest(1, len(list_filter(edges, lambda z: z < x))) AS k FROM {t} JOIN ed ON {t}.factor = ed.factor)"""


@query("bucket_analysis", f"""WITH {S.EVENTS_SQL}, {_LONG}, {_BUCKETS.format(t='l')}
SELECT factor, 'q' || k AS bucket, round(any_value(edges[k]), 6) AS lo, round(any_value(edges[k + 1]), 6) AS hi, count(*) AS n, round(avg(ret), 6) AS mean_ret, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM bm GROUP BY factor, k""")
def bucket_analysis(spark, sf):
    long = stats.unpivoted(S.order_events(spark, sf).withColumn("ret", F.col("target")), S.FACTORS, ["date", "ret"])
    out = stats.bucket_analysis(long, least=T.min_events, p_values=False).filter("core")
    return S.rounded(out.select("factor", "bucket", "lo", "hi", "n", "mean_ret", "win_rate"))


@query("tail_buckets", f"""WITH {S.EVENTS_SQL}, {_LONG}, q AS (SELECT factor, quantile_cont(x, 0.95) AS a, quantile_cont(x, 0.99) AS b, quantile_cont(x, 0.05) AS c, quantile_cont(x, 0.01) AS d FROM l GROUP BY factor HAVING count(DISTINCT x) > 20),
t AS (SELECT factor, 'tail_top5' AS bucket, ret FROM l JOIN q USING (factor) WHERE x >= a UNION ALL SELECT factor, 'tail_top1', ret FROM l JOIN q USING (factor) WHERE x >= b UNION ALL SELECT factor, 'tail_bot5', ret FROM l JOIN q USING (factor) WHERE x <= c UNION ALL SELECT factor, 'tail_bot1', ret FROM l JOIN q USING (factor) WHERE x <= d)
SELECT factor, bucket, count(*) AS n, round(avg(ret), 6) AS mean_ret FROM t GROUP BY 1, 2 HAVING count(*) >= 30""")
def tail_buckets(spark, sf):
    long = stats.unpivoted(S.order_events(spark, sf).withColumn("ret", F.col("target")), S.FACTORS, ["date", "ret"])
    return S.rounded(stats.bucket_analysis(long, least=T.min_events, p_values=False).filter("NOT core").select("factor", "bucket", "n", "mean_ret"))


@query("monotonicity", f"""WITH {S.EVENTS_SQL}, {_LONG}, {_BUCKETS.format(t='l')}, g AS (SELECT factor, k, avg(ret) AS m FROM bm GROUP BY 1, 2), r AS (SELECT factor, rank() OVER (PARTITION BY factor ORDER BY k) AS a, rank() OVER (PARTITION BY factor ORDER BY m) AS b FROM g)
SELECT factor, CASE WHEN count(*) >= 3 THEN round(corr(a, b), 6) END AS monotonicity FROM r GROUP BY factor""")
def monotonicity(spark, sf):
    long = stats.unpivoted(S.order_events(spark, sf).withColumn("ret", F.col("target")), S.FACTORS, ["date", "ret"])
    return S.rounded(stats.bucket_analysis(long, least=T.min_events, p_values=False).select("factor", "monotonicity").distinct())


@query("factor_score", f"""WITH {S.EVENTS_SQL}, {_LONG}, {_BUCKETS.format(t='l')}, g AS (SELECT factor, 'q' || k AS bucket, any_value(edges[k]) AS lo, avg(ret) AS m, count(*) AS n FROM bm GROUP BY factor, k)
SELECT factor, round(max(m) - min(m), 6) AS spread, arg_max(bucket, m) AS best_bucket, round(max(m), 6) AS best_mean, arg_max(n, m) AS best_n FROM g GROUP BY factor""")
def factor_score(spark, sf):
    long = stats.unpivoted(S.order_events(spark, sf).withColumn("ret", F.col("target")), S.FACTORS, ["date", "ret"])
    out = stats.factor_score(stats.bucket_analysis(long, least=T.min_events, p_values=False, tails=False))
    return S.rounded(out.select("factor", "spread", "best_bucket", "best_mean", "best_n"))


@query("bh_fdr", """WITH h AS (SELECT c_custkey AS k, c_mktsegment AS family, CASE WHEN c_custkey % 11 <> 0 THEN ((c_custkey * 7919) % 10007) / 10007.0 * ((c_custkey * 104729) % 1009) / 1009.0 * (CASE WHEN c_custkey % 5 = 0 THEN 0.001 ELSE 1.0 END) END AS p FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY family, p IS NULL ORDER BY p, k) AS i, count(p) OVER (PARTITION BY family) AS m FROM h),
l AS (SELECT *, max(CASE WHEN p <= 0.05 * i / m THEN i END) OVER (PARTITION BY family) AS last FROM r)
SELECT k, p IS NOT NULL AND coalesce(i <= last, false) AS fdr_pass FROM l""")
def bh_fdr(spark, sf):
    (c,) = S.tables(spark, sf, "customer")
    k = F.col("c_custkey")
    p = F.when(k % 11 != 0, (k * 7919 % 10007) / F.lit(10007.0) * (k * 104729 % 1009) / F.lit(1009.0) * F.when(k % 5 == 0, 0.001).otherwise(1.0))
    out = stats.benjamini_hochberg(c.select(k.alias("k"), F.col("c_mktsegment").alias("family"), p.alias("p")), "p", by=["family"], order=["k"])
    return out.select("k", "fdr_pass")


_HALVES = "round(avg(target) FILTER (WHERE date <= DATE '1999-12-31'), 6) AS is_mean, round(avg(target) FILTER (WHERE date > DATE '1999-12-31'), 6) AS oos_mean"


@query("train_test_split", f"WITH {S.EVENTS_SQL} SELECT symbol, {_HALVES}, count(*) FILTER (WHERE date <= DATE '1999-12-31') AS is_n, count(*) FILTER (WHERE date > DATE '1999-12-31') AS oos_n FROM e GROUP BY symbol")
def train_test_split(spark, sf):
    a, b = stats.split_by_date(S.order_events(spark, sf), S.SPLIT)
    x = a.groupBy("symbol").agg(F.avg("target").alias("is_mean"), F.count("*").alias("is_n"))
    return S.rounded(x.join(b.groupBy("symbol").agg(F.avg("target").alias("oos_mean"), F.count("*").alias("oos_n")), "symbol"))


_CONFIRM = "coalesce(oos_n >= 30 AND sign(is_mean) = sign(oos_mean) AND abs(oos_mean) >= 0.5 * abs(is_mean) AND abs(oos_mean) >= 0.03 AND abs(oos_t) >= 1.5, false)"
_FIGURES = """avg(ret) FILTER (WHERE date <= DATE '1999-12-31') AS is_mean, count(*) FILTER (WHERE date <= DATE '1999-12-31') AS is_n, avg(ret) FILTER (WHERE date > DATE '1999-12-31') AS oos_mean, count(*) FILTER (WHERE date > DATE '1999-12-31') AS oos_n,
avg(ret) FILTER (WHERE date > DATE '1999-12-31') / (stddev_samp(ret) FILTER (WHERE date > DATE '1999-12-31') / sqrt(count(*) FILTER (WHERE date > DATE '1999-12-31'))) AS oos_t"""
_SHOWN = f"is_n, round(is_mean, 6) AS is_mean, oos_n, round(oos_mean, 6) AS oos_mean, {_CONFIRM} AS confirmed"


def shown(df, *keys):
    return S.rounded(df.select(*keys, "is_n", "is_mean", F.coalesce("oos_n", F.lit(0)).cast("long").alias("oos_n"), "oos_mean", "confirmed"))


@query("oos_confirmation", f"WITH {S.EVENTS_SQL}, f AS (SELECT nation, {_FIGURES} FROM (SELECT *, target AS ret FROM e) GROUP BY nation) SELECT nation, {_SHOWN} FROM f")
def oos_confirmation(spark, sf):
    m = S.order_events(spark, sf).select("nation", F.col("target").alias("ret"), "date")
    return shown(stats.measured(m, ["nation"], S.SPLIT, on=None, p_values=False), "nation")


@query("spearman_ic", f"""WITH {S.EVENTS_SQL}, r AS (SELECT nation, rank() OVER (PARTITION BY nation ORDER BY qty) + (count(*) OVER (PARTITION BY nation, qty) - 1) / 2.0 AS a, rank() OVER (PARTITION BY nation ORDER BY target) + (count(*) OVER (PARTITION BY nation, target) - 1) / 2.0 AS b FROM e)
SELECT nation, round(corr(a, b), 6) AS ic, count(*) AS n FROM r GROUP BY nation""")
def spearman_ic(spark, sf):
    return S.rounded(stats.spearman(S.order_events(spark, sf), ["nation"], "qty", "target"))


@query("uniqueness_weights", f"WITH {S.EVENTS_SQL} SELECT event_id, round(1.0 / count(*) OVER (PARTITION BY date), 9) AS weight FROM e")
def uniqueness_weights(spark, sf):
    from tidemark.operators.models import uniqueness_weights as weights

    return S.rounded(weights(S.order_events(spark, sf)).select("event_id", "weight"), 9)


@query("flag_from_missing", f"WITH {S.DAYS_SQL} SELECT symbol, date, CASE WHEN CASE WHEN day(date) % 2 = 0 THEN close END > 250000 THEN 1 ELSE 0 END AS high FROM d", dates=("date",))
def flag_from_missing(spark, sf):
    return S.order_days(spark, sf).select("symbol", "date", flag(F.when(F.day("date") % 2 == 0, F.col("close")) > 250000).alias("high"))


