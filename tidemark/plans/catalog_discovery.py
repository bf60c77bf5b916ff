"""Queries of searches, tests, portfolios and models, with SQL twins where SQL can express them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidemark.functions.columns import normal_cdf
from tidemark.operators import discovery, formulas, hypotheses, joins, models, portfolio, regimes, stats, validation
from tidemark.plans import samples as S
from tidemark.plans.catalog import _BUCKETS, _FIGURES, _LONG, _SHOWN, query, shown

T = S.SAMPLE_SETTINGS
_TRAIN, _TEST = "date <= DATE '1999-12-31'", "date > DATE '1999-12-31'"


@query("single_factors", f"""WITH {S.EVENTS_SQL}, {_LONG}, lt AS (SELECT * FROM l WHERE {_TRAIN}), {_BUCKETS.format(t='lt')},
g AS (SELECT factor, 'q' || k AS bucket, edges[k] AS lo, edges[k + 1] AS hi, avg(ret) AS m FROM (SELECT factor, k, edges, ret FROM bm) GROUP BY factor, k, edges),
q AS (SELECT factor, quantile_cont(x, 0.95) AS a, quantile_cont(x, 0.99) AS b, quantile_cont(x, 0.05) AS c, quantile_cont(x, 0.01) AS d FROM lt GROUP BY factor HAVING count(DISTINCT x) > 20),
t AS (SELECT factor, 'tail_top5' AS bucket, a AS lo, NULL AS hi, avg(ret) AS m FROM lt JOIN q USING (factor) WHERE x >= a GROUP BY 1, 3 HAVING count(*) >= 30 UNION ALL SELECT factor, 'tail_top1', b, NULL, avg(ret) FROM lt JOIN q USING (factor) WHERE x >= b GROUP BY 1, 3 HAVING count(*) >= 30
      UNION ALL SELECT factor, 'tail_bot5', NULL, c, avg(ret) FROM lt JOIN q USING (factor) WHERE x <= c GROUP BY 1, 4 HAVING count(*) >= 30 UNION ALL SELECT factor, 'tail_bot1', NULL, d, avg(ret) FROM lt JOIN q USING (factor) WHERE x <= d GROUP BY 1, 4 HAVING count(*) >= 30),
z AS (SELECT * FROM g UNION ALL SELECT * FROM t), y AS (SELECT factor, arg_max(bucket, m) AS best_bucket, arg_max(coalesce(lo, -1e300), m) AS lo, arg_max(coalesce(hi, 1e300), m) AS hi, max(m) - min(m) AS spread FROM z GROUP BY factor),
w AS (SELECT l.factor, best_bucket, spread, ret, date FROM l JOIN y ON l.factor = y.factor AND CASE WHEN best_bucket LIKE 'tail_top%' THEN x >= lo WHEN best_bucket LIKE 'tail_bot%' THEN x <= hi ELSE x > lo AND x <= hi END)
SELECT factor, best_bucket, round(spread, 6) AS spread, round(avg(ret) FILTER (WHERE {_TRAIN}), 6) AS is_mean, round(avg(ret) FILTER (WHERE {_TEST}), 6) AS oos_mean, count(*) FILTER (WHERE {_TEST}) AS oos_n FROM w GROUP BY 1, 2, 3""")
def single_factors(spark, sf):
    out = discovery.single_factors(S.order_events(spark, sf), "target", S.FACTORS, T, p_values=False)
    return S.rounded(out.select("factor", "best_bucket", "spread", "is_mean", "oos_mean", "oos_n"))


@query("combos_k2_k3", f"""WITH {S.EVENTS_SQL}, r AS (SELECT *, acctbal > 5000 AS a, qty > 120 AS b, disc > 0.06 AS c, n_items > 3 AS d FROM e),
k AS (SELECT 'a AND b' AS combo, target AS ret, date FROM r WHERE a AND b UNION ALL SELECT 'a AND c', target, date FROM r WHERE a AND c UNION ALL SELECT 'a AND d', target, date FROM r WHERE a AND d UNION ALL SELECT 'b AND c', target, date FROM r WHERE b AND c
UNION ALL SELECT 'b AND d', target, date FROM r WHERE b AND d UNION ALL SELECT 'c AND d', target, date FROM r WHERE c AND d UNION ALL SELECT 'a AND b AND c', target, date FROM r WHERE a AND b AND c UNION ALL SELECT 'a AND b AND d', target, date FROM r WHERE a AND b AND d
UNION ALL SELECT 'a AND c AND d', target, date FROM r WHERE a AND c AND d UNION ALL SELECT 'b AND c AND d', target, date FROM r WHERE b AND c AND d), f AS (SELECT combo, {_FIGURES} FROM k GROUP BY combo HAVING count(*) FILTER (WHERE {_TRAIN}) >= 50) SELECT combo, {_SHOWN} FROM f""")
def combos(spark, sf):
    from itertools import combinations

    one = {"a": F.col("acctbal") > 5000, "b": F.col("qty") > 120, "c": F.col("disc") > 0.06, "d": F.col("n_items") > 3}
    conditions = {}
    for k in (2, 3):
        for names in combinations(one, k):
            met = one[names[0]]
            for n in names[1:]:
                met = met & one[n]
            conditions[" AND ".join(names)] = met
    members = discovery.condition_members(S.order_events(spark, sf), conditions, "target", name="combo")
    return shown(stats.measured(members, ["combo"], S.SPLIT, on=None, p_values=False).filter(F.col("is_n") >= T.min_events), "combo")


@query("optimal_threshold", f"""WITH {S.EVENTS_SQL}, {_LONG}, lt AS (SELECT * FROM l WHERE {_TRAIN}), n AS (SELECT factor, list_sort(list_distinct([{', '.join(f'quantile_cont(x, {i / 20})' for i in range(1, 20))}])) AS cuts FROM lt GROUP BY factor HAVING count(*) >= 100 AND count(DISTINCT x) >= 5),
c AS (SELECT factor, unnest(cuts) AS cut, unnest(range(len(cuts))) AS k FROM n),
s AS (SELECT c.factor, cut, k, avg(ret) FILTER (WHERE x > cut) - avg(ret) FILTER (WHERE x <= cut) AS diff FROM c JOIN lt ON lt.factor = c.factor GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE x > cut) >= 50 AND count(*) FILTER (WHERE x <= cut) >= 50),
b AS (SELECT factor, cut, diff FROM s QUALIFY row_number() OVER (PARTITION BY factor ORDER BY round(abs(diff), 9) DESC, k) = 1),
m AS (SELECT l.factor, cut, CASE WHEN diff > 0 THEN '>' ELSE '<=' END AS side, ret, date FROM l JOIN b ON l.factor = b.factor AND CASE WHEN diff > 0 THEN x > cut ELSE x <= cut END),
f AS (SELECT factor, round(cut, 6) AS cut, side, {_FIGURES} FROM m GROUP BY factor, cut, side) SELECT factor, cut, side, {_SHOWN} FROM f""")
def optimal_threshold(spark, sf):
    return shown(discovery.optimal_thresholds(S.order_events(spark, sf), "target", S.FACTORS, T, p_values=False, least_kinds=5), "factor", "cut", "side")


@query("regime_conditional", f"""WITH {S.EVENTS_SQL}, r AS (SELECT 'early' AS regime, * FROM e WHERE day(date) <= 10 UNION ALL SELECT 'late', * FROM e WHERE day(date) >= 20),
l AS (SELECT regime, 'qty' AS factor, qty AS x, target AS ret, date FROM r UNION ALL SELECT regime, 'acctbal', acctbal, target, date FROM r),
md AS (SELECT regime, factor, quantile_cont(x, 0.5) AS med FROM l WHERE {_TRAIN} GROUP BY 1, 2), h AS (SELECT l.*, med, CASE WHEN x > med THEN '>' ELSE '<=' END AS side FROM l JOIN md USING (regime, factor)),
g AS (SELECT regime, factor, side, {_FIGURES} FROM h GROUP BY 1, 2, 3), b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY regime, factor ORDER BY abs(is_mean) DESC, side) = 1 AND min(is_n) OVER (PARTITION BY regime, factor) >= 50),
a AS (SELECT regime, '(baseline)' AS factor, {_FIGURES} FROM (SELECT regime, target AS ret, date FROM r) GROUP BY regime)
SELECT regime, factor, {_SHOWN} FROM a UNION ALL SELECT regime, factor || ' ' || side, {_SHOWN} FROM b""")
def regime_conditional(spark, sf):
    both = {"early": F.day("date") <= 10, "late": F.day("date") >= 20}
    out = discovery.regime_conditional(S.order_events(spark, sf), "target", ["qty", "acctbal"], (both, both), T, p_values=False)
    return shown(out.withColumn("factor", F.regexp_replace("factor", r" [0-9.e+-]+$", "")), "regime", "factor")


@query("edge_decay", f"""WITH {S.RULES_SQL}, y AS (SELECT rule, year(date) AS year, avg(net) AS m, count(*) AS n FROM m GROUP BY 1, 2 HAVING count(*) >= 20), k AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY year) AS k, count(*) OVER (PARTITION BY rule) AS c FROM y),
f AS (SELECT rule, count(*) AS years_active, avg(m) FILTER (WHERE k <= c // 2) AS e, avg(m) FILTER (WHERE k > c // 2) AS r, regr_slope(m, k) AS t, avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END) AS p FROM k WHERE c >= 4 GROUP BY rule)
SELECT rule, years_active, round(e, 6) AS early_mean, round(r, 6) AS recent_mean, round(t, 6) AS yearly_trend, round(p, 6) AS pct_years_positive, CASE WHEN r < 0.5 * e AND e > 0 THEN 'DECAYING' WHEN r > 1.5 * e THEN 'STRENGTHENING' ELSE 'STABLE' END AS status FROM f""")
def edge_decay(spark, sf):
    return S.rounded(discovery.edge_decay(S.rule_members(spark, sf).withColumnRenamed("net", "ret")))


@query("rule_strings", f"""WITH {S.EVENTS_SQL} SELECT 'a' AS rule, count(*) AS n FROM e WHERE qty <= 100 AND acctbal > 0 UNION ALL SELECT 'b', count(*) FROM e WHERE disc > 0.02 AND disc <= 0.07 AND n_items > 2 UNION ALL SELECT 'c', count(*) FROM e WHERE n_items = 3""")
def rule_strings(spark, sf):
    e = S.order_events(spark, sf)
    rules = {"a": "qty <= 100 AND acctbal > 0", "b": "disc in (0.02, 0.07] AND n_items > 2", "c": "n_items in 3"}
    conditions = {k: discovery.rule_condition(r, e.columns) for k, r in rules.items()}
    return discovery.condition_members(e, conditions, "target", name="rule").groupBy("rule").agg(F.count("*").alias("n"))


@query("lead_lag_ic", f"""WITH {S.EVENTS_SQL}, s AS (SELECT *, {_TRAIN} AS tr FROM e), g AS (SELECT tr, target AS y, unnest([1, 2, 3]) AS k, unnest([lag(qty, 1) OVER w, lag(qty, 2) OVER w, lag(qty, 3) OVER w]) AS x FROM s WINDOW w AS (PARTITION BY symbol, tr ORDER BY date, event_id)),
r AS (SELECT tr, k, rank() OVER (PARTITION BY tr, k ORDER BY x) + (count(*) OVER (PARTITION BY tr, k, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY tr, k ORDER BY y) + (count(*) OVER (PARTITION BY tr, k, y) - 1) / 2.0 AS b FROM g WHERE x IS NOT NULL),
i AS (SELECT tr, k, corr(a, b) AS ic, count(*) AS n FROM r GROUP BY 1, 2)
SELECT 'qty' AS factor, CAST(p.k AS INTEGER) AS extra_lag_days, round(p.ic, 6) AS is_rank_ic, round(o.ic, 6) AS oos_rank_ic, p.n, coalesce(sign(p.ic) = sign(o.ic) AND abs(o.ic) >= 0.5 * abs(p.ic), false) AS confirmed FROM i p JOIN i o ON p.k = o.k AND p.tr AND NOT o.tr""")
def lead_lag_ic(spark, sf):
    out = discovery.lead_lag(S.order_events(spark, sf), "target", ["qty"], 3, T, p_values=False, order=("date", "event_id"))
    return S.rounded(out.select("factor", "extra_lag_days", "is_rank_ic", "oos_rank_ic", "n", "confirmed"))


@query("sequence_patterns", f"""WITH {S.EVENTS_SQL}, o AS (SELECT *, CASE WHEN target > 0 THEN 'W' ELSE 'L' END AS o FROM e), h AS (SELECT *, lag(o, 1) OVER w AS h1, lag(o, 2) OVER w AS h2, lag(o, 3) OVER w AS h3 FROM o WINDOW w AS (PARTITION BY symbol ORDER BY date, event_id)),
p AS (SELECT 'last 1 outcomes = ' || h1 AS pattern, target AS ret, date FROM h UNION ALL SELECT 'last 2 outcomes = ' || h2 || h1, target, date FROM h UNION ALL SELECT 'last 3 outcomes = ' || h3 || h2 || h1, target, date FROM h),
f AS (SELECT pattern, {_FIGURES} FROM p WHERE pattern IS NOT NULL GROUP BY pattern HAVING count(*) FILTER (WHERE {_TRAIN}) >= 50) SELECT pattern, {_SHOWN} FROM f""")
def sequence_patterns(spark, sf):
    return shown(discovery.sequence_patterns(S.order_events(spark, sf), "target", 3, T, p_values=False, order=("date", "event_id")), "pattern")


@query("anomaly_precursors", f"""WITH {S.EVENTS_SQL}, z AS (SELECT *, CASE WHEN count(qty) OVER w >= 20 THEN (qty - avg(qty) OVER w) / nullif(stddev_samp(qty) OVER w, 0) END AS z FROM e WINDOW w AS (PARTITION BY symbol ORDER BY date, event_id ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
g AS (SELECT date, target AS ret, unnest(['qty_lag1', 'qty_lag2', 'qty_lag3']) AS anomaly, unnest([abs(lag(z, 1) OVER w) >= 1.5, abs(lag(z, 2) OVER w) >= 1.5, abs(lag(z, 3) OVER w) >= 1.5]) AS hit FROM z WINDOW w AS (PARTITION BY symbol ORDER BY date, event_id)),
f AS (SELECT anomaly, {_FIGURES.replace('FILTER (WHERE ', 'FILTER (WHERE hit AND ')}, avg(ret) FILTER (WHERE NOT hit AND {_TRAIN}) AS base_mean FROM g WHERE hit IS NOT NULL GROUP BY anomaly) SELECT anomaly, round(base_mean, 6) AS base_mean, round(is_mean - base_mean, 6) AS lift, {_SHOWN} FROM f WHERE is_n >= 50""")
def anomaly_precursors(spark, sf):
    return shown(discovery.anomaly_precursors(S.order_events(spark, sf), "target", ["qty"], 1.5, T, p_values=False, order=("date", "event_id")), "anomaly", "base_mean", "lift")


_CALENDAR = " UNION ALL ".join(
    f"SELECT '{n}' AS condition, target AS ret, date FROM e WHERE {c}"
    for n, c in [*((f"weekday_{n}", f"isodow(date) = {i + 1}") for i, n in enumerate(("mon", "tue", "wed", "thu", "fri"))), ("month_start_d1_3", "day(date) <= 3"), ("month_end_d28p", "day(date) >= 28"), ("expiry_week", "day(date) >= 22 AND isodow(date) = 4"), *((f"month_{m}", f"month(date) = {m}") for m in range(1, 13))]
)


@query("calendar_scan", f"WITH {S.EVENTS_SQL}, k AS ({_CALENDAR}), f AS (SELECT condition, {_FIGURES} FROM k GROUP BY condition HAVING count(*) FILTER (WHERE {_TRAIN}) >= 50) SELECT condition, {_SHOWN} FROM f")
def calendar_scan(spark, sf):
    return shown(discovery.calendar_scan(S.order_events(spark, sf), "target", T, p_values=False), "condition")


@query("hypothesis_rules", f"""WITH {S.EVENTS_SQL}, g AS (SELECT date, target, acctbal / 2000 AS gap, qty / 50 - 1 AS z, target * 2 AS r, disc * 10 AS dv FROM e),
m AS (SELECT 'H12_idiosyncratic_gap_fade' AS hypothesis, -target AS ret, date FROM g WHERE abs(r) > 1 UNION ALL SELECT 'H13_delivery_spike_reversal', target, date FROM g WHERE z > 2 AND r < -1 UNION ALL SELECT 'H01_delivery_gap_continuation', target, date FROM g WHERE gap > 0.5 AND z > 1),
f AS (SELECT hypothesis, count(*) FILTER (WHERE {_TRAIN}) AS n_train, count(*) FILTER (WHERE {_TEST}) AS n_test, round(avg(ret) FILTER (WHERE {_TRAIN}), 6) AS train_mean, round(avg(ret) FILTER (WHERE {_TEST}), 6) AS oos_mean FROM m GROUP BY 1) SELECT * FROM f""")
def hypothesis_rules(spark, sf):
    e = S.order_events(spark, sf)
    p = e.select("date", "target", (F.col("acctbal") / 2000).alias("gap_pct"), (F.col("qty") / 50 - 1).alias("delivery_z20"), (F.col("target") * 2).alias("gap_idiosyncratic"), (F.col("target") * 2).alias("ret_1d"))
    out = hypotheses.run_hypotheses(p, "target", T, p_values=False)
    return S.rounded(out.filter("status <> 'missing data' AND n_train > 0").select("hypothesis", "n_train", "n_test", "train_mean", "oos_mean"))


@query("walkforward_folds", f"""WITH {S.RULES_SQL}, n AS (SELECT *, ntile(5) OVER (PARTITION BY rule ORDER BY date, event_id) AS fold, count(*) OVER (PARTITION BY rule) AS c FROM m), b AS (SELECT *, min(date) OVER (PARTITION BY rule, fold) + 5 AS a, max(date) OVER (PARTITION BY rule, fold) - 5 AS z FROM n WHERE c >= 100),
f AS (SELECT rule, fold, avg(net) AS m FROM b WHERE fold IN (1, 5) OR date BETWEEN a AND z GROUP BY 1, 2 HAVING count(*) >= 10)
SELECT rule, round(avg(m), 6) AS cv_mean, count(*) FILTER (WHERE m > 0) AS cv_positive, count(*) AS cv_folds, count(*) FILTER (WHERE m > 0) >= ceil(count(*) * 0.6) AND avg(m) > 0 AS cv_pass FROM f GROUP BY rule""")
def walkforward_folds(spark, sf):
    out = validation.walk_forward(S.rule_members(spark, sf), T, ("date", "event_id"))
    return S.rounded(out.select("rule", "cv_mean", "cv_positive", "cv_folds", "cv_pass"))


_CSCV = f"""WITH {S.RULES_SQL}, dy AS (SELECT date, ntile(8) OVER (ORDER BY date) - 1 AS block FROM (SELECT DISTINCT date FROM m)), ce AS (SELECT rule, block, avg(net) AS v FROM m JOIN dy USING (date) GROUP BY 1, 2 HAVING count(*) >= 5),
sp AS (SELECT CAST(range AS INTEGER) AS split FROM range(256) WHERE bit_count(CAST(range AS INTEGER)) = 4), pf AS (SELECT split, rule, avg(v) FILTER (WHERE (split >> CAST(block AS INTEGER)) & 1 = 1) AS a, avg(v) FILTER (WHERE (split >> CAST(block AS INTEGER)) & 1 = 0) AS b FROM sp, ce GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY a DESC NULLS LAST, rule) AS win, count(b) OVER (PARTITION BY split) AS n, rank() OVER (PARTITION BY split ORDER BY b) + (count(*) OVER (PARTITION BY split, b) - 1) / 2.0 AS r FROM pf WHERE b IS NOT NULL OR a IS NOT NULL)"""


@query("cscv_splits", _CSCV + " SELECT CAST(split AS BIGINT) AS split, rule AS winner, round(greatest(-10, least(10, ln(r / (n + 1) / (1 - r / (n + 1))))), 6) AS logit FROM rk WHERE win = 1 AND b IS NOT NULL")
def cscv_splits(spark, sf):
    return S.rounded(validation.cscv_splits(S.rule_members(spark, sf), T))


@query("cscv_pbo", _CSCV + " SELECT round(avg(CASE WHEN r / (n + 1) <= 0.5 THEN 1.0 ELSE 0.0 END), 3) AS pbo, avg(CASE WHEN r / (n + 1) <= 0.5 THEN 1.0 ELSE 0.0 END) <= 0.5 AS pbo_pass FROM rk WHERE win = 1 AND b IS NOT NULL")
def cscv_pbo(spark, sf):
    return validation.cscv_pbo(S.rule_members(spark, sf), T)


@query("deflated_sharpe_moments", f"""WITH {S.RULES_SQL}, c AS (SELECT rule, net - avg(net) OVER (PARTITION BY rule) AS d, net FROM m) SELECT rule, count(*) AS n, round(avg(net), 6) AS mean, round(stddev_samp(net), 6) AS sd, round(avg(d * d * d) / power(avg(d * d), 1.5), 5) AS skew, round(avg(d * d * d * d) / power(avg(d * d), 2), 5) AS kurt FROM c GROUP BY rule""")
def deflated_sharpe_moments(spark, sf):
    return S.rounded(validation.moments(S.rule_members(spark, sf)), skew=5, kurt=5)


_CUTS = T.boundary_dates


@query("multi_boundary", f"""WITH {S.RULES_SQL}, f AS (SELECT rule, {', '.join(f"CASE WHEN count(*) FILTER (WHERE date > DATE '{b}') >= 20 THEN avg(net) FILTER (WHERE date > DATE '{b}') END AS m{i}, count(*) FILTER (WHERE date > DATE '{b}') AS n{i}" for i, b in enumerate(_CUTS))} FROM m GROUP BY rule)
SELECT rule, {', '.join(f'round(m{i}, 4) AS m{i}, n{i}' for i in range(3))}, (CASE WHEN m0 > 0 THEN 1 ELSE 0 END + CASE WHEN m1 > 0 THEN 1 ELSE 0 END + CASE WHEN m2 > 0 THEN 1 ELSE 0 END) >= 2 AS boundary_pass FROM f""")
def multi_boundary(spark, sf):
    out = validation.boundaries(S.rule_members(spark, sf), T)
    return out.select("rule", *(F.col(f"oos_after_{b}").alias(f"m{i}") for i, b in enumerate(_CUTS)), *(F.col(f"n_after_{b}").alias(f"n{i}") for i, b in enumerate(_CUTS)), "boundary_pass")


def _chosen(spark, sf):
    e = S.order_events(spark, sf)
    rules = {"bulk": F.col("qty") > 120, "monday": F.weekday("date") == 0}
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.coalesce(c, F.lit(False)).alias("chosen")) for n, c in rules.items())))
    return e.select("date", (F.col("target") - 0.06).alias("net"), each.alias("r")).select("date", "net", "r.*")


@query("permutation_p")
def permutation_p(spark, sf):
    return validation.permutation_test(_chosen(spark, sf), T)


@query("bootstrap_ci")
def bootstrap_ci(spark, sf):
    return validation.bootstrap_ci(S.rule_members(spark, sf), T, order=("date", "event_id"))


@query("spa_stepdown")
def spa_stepdown(spark, sf):
    return validation.spa_stepdown(S.rule_members(spark, sf))


@query("gauntlet")
def gauntlet(spark, sf):
    return validation.gauntlet(_chosen(spark, sf), 20, T)


@query("daily_matrix", f"""WITH {S.RULES_SQL}, p AS (SELECT rule, date, avg(net) AS r FROM m GROUP BY 1, 2), g AS (SELECT * FROM (SELECT DISTINCT date FROM p), (SELECT DISTINCT rule FROM p)) SELECT g.date, g.rule, round(coalesce(r, 0.0), 11) AS ret FROM g LEFT JOIN p USING (rule, date)""", dates=("date",))
def daily_matrix(spark, sf):
    return S.rounded(validation.daily_matrix(S.rule_members(spark, sf)), 11)


@query("signal_overlap", f"""WITH {S.RULES_SQL}, p AS (SELECT DISTINCT rule, date FROM m) SELECT a.rule AS rule_a, b.rule AS rule_b, round(count(*) / ((SELECT count(*) FROM p WHERE rule = a.rule) + (SELECT count(*) FROM p WHERE rule = b.rule) - count(*)), 3) AS overlap
FROM p a JOIN p b ON a.date = b.date AND a.rule < b.rule GROUP BY 1, 2""")
def signal_overlap(spark, sf):
    return portfolio.signal_overlap(S.rule_members(spark, sf))


@query("pnl_corr", f"""WITH {S.RULES_SQL}, p AS (SELECT rule, date, avg(net) AS v FROM m GROUP BY 1, 2) SELECT a.rule AS rule_a, b.rule AS rule_b, round(corr(a.v, b.v), 6) AS corr, count(*) AS days, coalesce(abs(corr(a.v, b.v)) > 0.7 AND count(*) >= 20, false) AS flagged
FROM p a JOIN p b ON a.date = b.date AND a.rule < b.rule GROUP BY 1, 2""")
def pnl_corr(spark, sf):
    return S.rounded(portfolio.pnl_correlation(S.rule_members(spark, sf), T))


_BOOK = f"""WITH {S.RULES_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY rule, event_id) <= 10 AS kept FROM m), y AS (SELECT date, sum(net) FILTER (WHERE kept) / 10 AS pnl, count(*) AS trades FROM k GROUP BY date),
g AS (SELECT CAST(unnest(generate_series((SELECT min(date) FROM y), (SELECT max(date) FROM y), INTERVAL 1 DAY)) AS DATE) AS date), q AS (SELECT g.date, coalesce(pnl, 0.0) AS pnl, coalesce(trades, 0) AS trades FROM g LEFT JOIN y ON y.date = g.date WHERE isodow(g.date) < 6),
v AS (SELECT *, exp(sum(ln(1 + pnl / 100)) OVER (ORDER BY date)) AS equity FROM q), w AS (SELECT *, (equity / max(equity) OVER (ORDER BY date) - 1) * 100 AS dd FROM v)"""


@query("drawdown_curve", _BOOK + " SELECT date, round(pnl, 6) AS pnl, trades, round(equity, 6) AS equity, round(dd, 6) AS drawdown_pct FROM w", dates=("date",))
def drawdown_curve(spark, sf):
    return S.rounded(portfolio.book_days(S.rule_members(spark, sf), ["event_id"], T))


@query("combined_book", _BOOK + """ SELECT count(*) FILTER (WHERE pnl <> 0) AS n_trade_days, count(*) AS n_calendar_days, (SELECT count(*) FROM k) AS n_trades_total, (SELECT count(*) FROM k WHERE NOT kept) AS n_trades_capped_out,
round(avg(pnl) * 252, 2) AS ann_return_pct, round(stddev_samp(pnl) * sqrt(252.0), 2) AS ann_vol_pct, round(avg(pnl) * 252 / (stddev_samp(pnl) * sqrt(252.0)), 2) AS sharpe, round(min(dd), 2) AS max_drawdown_pct, round(avg(pnl) * 252 / abs(min(dd)), 2) AS calmar,
(SELECT CAST(floor(quantile_cont(trades, 0.5)) AS BIGINT) FROM y) AS concurrency_p50, (SELECT CAST(floor(quantile_cont(trades, 0.95)) AS BIGINT) FROM y) AS concurrency_p95, (SELECT max(trades) FROM y) AS concurrency_max FROM w""")
def combined_book(spark, sf):
    return portfolio.combined_book(S.rule_members(spark, sf), ["event_id"], T)


@query("capacity", f"WITH {S.RULES_SQL} SELECT rule, count(*) AS n_events, round(quantile_cont(open30_value, 0.5), 0) AS median_entry_value, round(quantile_cont(open30_value, 0.5) * 5 / 100, 0) AS max_notional, round(quantile_cont(open30_value, 0.5) * 5 / 100 / 1000000, 1) AS vs_assumed_trade_size FROM m GROUP BY rule")
def capacity(spark, sf):
    return portfolio.capacity(S.rule_members(spark, sf), "open30_value", T)


@query("cusum_drift", f"""WITH {S.RULES_SQL}, b AS (SELECT rule, avg(net) AS mu, stddev_samp(net) AS sd FROM m WHERE {_TRAIN} GROUP BY rule HAVING count(*) >= 50), s AS (SELECT m.rule, date, event_id, mu, sd, sum(mu - net - 0.25 * sd) OVER (PARTITION BY m.rule ORDER BY date, event_id ROWS UNBOUNDED PRECEDING) AS s FROM m JOIN b ON b.rule = m.rule WHERE {_TEST}),
c AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY rule ORDER BY date, event_id ROWS UNBOUNDED PRECEDING)) AS c FROM s)
SELECT rule, round(any_value(mu), 4) AS train_mean, round(max(c / sd), 2) AS cusum_peak_sigma, min(date) FILTER (WHERE c > 8 * sd) AS alarm_date, min(date) FILTER (WHERE c > 8 * sd) IS NOT NULL AS drift_alarm FROM c GROUP BY rule""", dates=("alarm_date",))
def cusum_drift(spark, sf):
    return regimes.cusum_drift(S.rule_members(spark, sf), T, ("date", "event_id"))


@query("james_stein", f"""WITH {S.RULES_SQL}, g AS (SELECT rule, avg(net) AS grand, var_samp(net) AS v FROM m GROUP BY 1), s AS (SELECT rule, symbol, avg(net) AS mean, count(*) AS n FROM m GROUP BY 1, 2 HAVING count(*) >= 10),
h AS (SELECT s.*, grand, grand + (1 - (v / n) / (power(mean - grand, 2) + v / n)) * (mean - grand) AS shrunk, greatest(mean * n, 0) AS gain FROM s JOIN g USING (rule))
SELECT rule, count(*) AS n_symbols, round(any_value(grand), 4) AS pooled_mean, round(avg(CASE WHEN shrunk > 0 THEN 1.0 ELSE 0.0 END), 3) AS shrunk_pos_frac, CASE WHEN sum(gain) > 0 THEN round(sum(gain * gain) / power(sum(gain), 2), 3) END AS concentration_hhi,
avg(CASE WHEN shrunk > 0 THEN 1.0 ELSE 0.0 END) >= 0.6 AND (NOT sum(gain) > 0 OR sum(gain * gain) / power(sum(gain), 2) <= 0.15) AS broad_edge FROM h GROUP BY rule HAVING count(*) >= 5""")
def james_stein(spark, sf):
    return regimes.james_stein(S.rule_members(spark, sf))


@query("edge_by_regime", f"""WITH {S.RULES_SQL}, r AS (SELECT rule, net, date, month(date) % 3 AS regime FROM m), f AS (SELECT rule, regime, count(*) FILTER (WHERE {_TRAIN}) AS n_train, count(*) FILTER (WHERE {_TEST}) AS n_oos, avg(net) FILTER (WHERE {_TRAIN}) AS a, avg(net) FILTER (WHERE {_TEST}) AS b FROM r GROUP BY 1, 2)
SELECT rule, CAST(regime AS INTEGER) AS regime, n_train, n_oos, round(a, 4) AS train_mean, round(b, 4) AS oos_mean, coalesce(n_train >= 50 AND n_oos >= 20 AND a > 0 AND b > 0, false) AS tradeable_in_regime FROM f""")
def edge_by_regime(spark, sf):
    m = S.rule_members(spark, sf)
    days = m.select("date").distinct().withColumn("regime", F.month("date") % 3)
    return discovery.edges_by_regime(m, days, T)


@query("kmeans_regimes")
def kmeans_regimes(spark, sf):
    return regimes.hidden_clusters(S.order_events(spark, sf), "target", S.FACTORS, 4, T)


@query("gmm_regimes")
def gmm_regimes(spark, sf):
    return regimes.market_regimes(S.order_events(spark, sf), S.FACTORS[:3], T)


@query("gbt_deciles")
def gbt_deciles(spark, sf):
    predicted, _, _ = models.all_factors_model(S.order_events(spark, sf), "target", S.FACTORS, T, least=(100, 40))
    return models.decile_report(predicted, "target")


@query("meta_label")
def meta_label(spark, sf):
    fired = S.order_events(spark, sf).filter("qty > 60").withColumn("net", F.col("target"))
    return models.meta_label(fired, S.FACTORS, replace(T, meta_min_events=100))


_RANK = "(rank() OVER (PARTITION BY g ORDER BY {x}) + (count(*) OVER (PARTITION BY g, {x}) - 1) / 2.0)"


@query("gp_eval_fixed_formulas", f"""WITH {S.EVENTS_SQL}, v AS (SELECT target AS y, qty, disc, acctbal, avg(qty) OVER w5 AS m5, count(qty) OVER w5 AS c5, qty - lag(qty, 5) OVER w AS d5 FROM e WINDOW w AS (PARTITION BY symbol ORDER BY date, event_id), w5 AS (PARTITION BY symbol ORDER BY date, event_id ROWS 4 PRECEDING)),
l AS (SELECT 0 AS k, y, qty * disc AS x FROM v UNION ALL SELECT 1, y, greatest(qty, abs(acctbal)) FROM v UNION ALL SELECT 2, y, CASE WHEN c5 = 5 THEN m5 END FROM v UNION ALL SELECT 3, y, sign(d5) * ln(1 + abs(d5)) FROM v UNION ALL SELECT 4, y, acctbal / nullif(disc, 0) FROM v),
r AS (SELECT k, rank() OVER (PARTITION BY k ORDER BY x) + (count(*) OVER (PARTITION BY k, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY k ORDER BY y) + (count(*) OVER (PARTITION BY k, y) - 1) / 2.0 AS b FROM l WHERE x IS NOT NULL) SELECT k, round(corr(a, b), 6) AS ic, count(*) AS n FROM r GROUP BY k""")
def gp_eval(spark, sf):
    texts = ["mul(qty, disc)", "max(qty, abs(acctbal))", "ts_mean5(qty)", "log1p_abs(ts_delta5(qty))", "div(acctbal, disc)"]
    out = formulas.scores(S.order_events(spark, sf), [formulas.parse(t) for t in texts], ["target"])
    return S.rounded(out.select("k", "ic", "n"))


@query("gp_evolve")
def gp_evolve(spark, sf):
    return formulas.evolve(S.order_events(spark, sf), "target", S.FACTORS, s=replace(T, gp_population=12, gp_generations=2, gp_max_depth=3))


@query("gp_top_decile", f"WITH {S.EVENTS_SQL}, v AS (SELECT event_id, qty * disc AS x FROM e), q AS (SELECT quantile_cont(x, 0.9) AS h FROM v) SELECT event_id, coalesce(x >= h, false) AS chosen FROM v, q")
def gp_top_decile(spark, sf):
    return formulas.top_decile(S.order_events(spark, sf), "mul(qty, disc)", 0.1).select("event_id", "chosen")


@query("top_decile_churn", f"""WITH {S.EVENTS_SQL}, q AS (SELECT quantile_cont(qty, 0.9) AS h FROM e), y AS (SELECT date, avg(CASE WHEN qty > h THEN 1.0 ELSE 0.0 END) AS t FROM e, q GROUP BY date) SELECT round(avg(abs(c)), 6) AS churn FROM (SELECT t - lag(t) OVER (ORDER BY date) AS c FROM y)""")
def top_decile_churn(spark, sf):
    alphas = spark.createDataFrame([("qty", 0.1, True)], "formula string, oos_ic double, confirmed boolean")
    return S.rounded(formulas.review_pack(alphas, S.order_events(spark, sf)).select(F.col("top_decile_daily_churn").alias("churn")))


@query("normal_cdf", """WITH k AS (SELECT c_custkey, c_acctbal / 3000 AS x, 1 / (1 + 0.2316419 * abs(c_acctbal / 3000)) AS t FROM customer), u AS (SELECT *, 0.3989422804014327 * exp(-x * x / 2) * (((((1.330274429 * t - 1.821255978) * t + 1.781477937) * t - 0.356563782) * t + 0.319381530) * t) AS u FROM k)
SELECT c_custkey, round(CASE WHEN x >= 0 THEN 1 - u ELSE u END, 9) AS p FROM u""")
def normal_cdf_query(spark, sf):
    (c,) = S.tables(spark, sf, "customer")
    return S.rounded(c.select("c_custkey", normal_cdf(F.col("c_acctbal") / 3000).alias("p")), 9)


@query("union_and_dedupe", f"""WITH {S.EVENTS_SQL}, k AS (SELECT symbol, date, event_id FROM e WHERE qty > 100 UNION ALL SELECT symbol, date, event_id FROM e WHERE acctbal > 3000) SELECT symbol, date, min(event_id) AS event_id FROM k GROUP BY 1, 2""", dates=("date",))
def union_and_dedupe(spark, sf):
    e = S.order_events(spark, sf).select("symbol", "date", "event_id", "qty", "acctbal")
    both = e.filter("qty > 100").unionByName(e.filter("acctbal > 3000"))
    return both.groupBy("symbol", "date").agg(F.min("event_id").alias("event_id"))


@query("robust_and_confirmed", f"""WITH {S.RULES_SQL}, a AS (SELECT rule FROM m WHERE date > DATE '1997-12-31' GROUP BY rule HAVING avg(net) > 0) SELECT rule, count(*) AS n FROM m WHERE rule IN (SELECT rule FROM a) GROUP BY rule""")
def robust_and_confirmed(spark, sf):
    m = S.rule_members(spark, sf)
    good = m.filter("date > DATE '1997-12-31'").groupBy("rule").agg(F.avg("net").alias("v")).filter("v > 0")
    return m.join(good, "rule", "left_semi").groupBy("rule").agg(F.count("*").alias("n"))


@query("exact_lookup", f"WITH {S.EVENTS_SQL}, p AS (SELECT date, max(qty) AS top FROM e WHERE symbol = 'MACHINERY' GROUP BY date) SELECT event_id, top FROM e LEFT JOIN p ON p.date = e.date")
def exact_lookup(spark, sf):
    e = S.order_events(spark, sf)
    top = e.filter("symbol = 'MACHINERY'").groupBy("date").agg(F.max("qty").alias("top"))
    return joins.exact(e.select("event_id", "date"), top, ["date"]).select("event_id", "top")


@query("coverage_filter", f"WITH {S.EVENTS_SQL} SELECT 'qty' AS name WHERE (SELECT count(DISTINCT qty) FROM e) >= 20 UNION ALL SELECT 'acctbal' WHERE (SELECT count(DISTINCT acctbal) FROM e) >= 20")
def coverage_filter(spark, sf):
    names = discovery.covered_columns(S.order_events(spark, sf), ["qty", "acctbal", "disc", "n_items"], kinds=20)
    return spark.createDataFrame([(n,) for n in names], "name string")


