"""Queries of p values and what is decided by them, with twins that sum Student's t distribution term by term."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import discovery, joins, stats, validation
from tidemark.plans import samples as S
from tidemark.plans.catalog import _BUCKETS, _KISH, _LONG, query
from tidemark.plans.catalog_discovery import _CALENDAR, _CUTS
from tidemark.plans.research import confirmed_rules

T = S.SAMPLE_SETTINGS
_TRAIN, _TEST = "date <= DATE '1999-12-31'", "date > DATE '1999-12-31'"


def p_sql(t: str, nu: str) -> str:
    """P(|T| >= |t|) for whole degrees of freedom: the finite series in powers of the cosine of atan(t / sqrt(nu))."""
    cos2 = f"({nu} / ({nu} + {t} * {t}))"
    sin = f"(abs({t}) / sqrt({nu} + {t} * {t}))"
    even = f"{sin} * list_sum(list_transform(range(CAST({nu} // 2 AS BIGINT)), lambda j: exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1) + j * ln({cos2}))))"
    odd = f"2 / pi() * (atan(abs({t}) / sqrt({nu})) + {sin} * coalesce(list_sum(list_transform(range(CAST(({nu} - 1) // 2 AS BIGINT)), lambda j: exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5) + (j + 0.5) * ln({cos2})))), 0.0))"
    return f"(1 - CASE WHEN {nu} % 2 = 0 THEN {even} ELSE {odd} END)"


def fdr_sql(source: str, key: str, p: str) -> str:
    """CTEs r and v: source with fdr_pass by Benjamini and Hochberg; equal p values in the order of key."""
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY {p} IS NULL ORDER BY {p}, {key}) AS bh_i, count({p}) OVER () AS bh_m FROM {source}),
v AS (SELECT *, {p} IS NOT NULL AND coalesce(bh_i <= max(CASE WHEN {p} <= 0.05 * bh_i / bh_m THEN bh_i END) OVER (), false) AS fdr_pass FROM r)"""


def _in_sample(source: str, keys: str, least: str = "") -> str:
    """CTE g: keys with is_n and the p value of the in-sample mean, every event counted as one."""
    return f"""h AS (SELECT {keys}, count(*) AS is_n, avg(ret) AS a, stddev_samp(ret) AS sd FROM {source} WHERE {_TRAIN} GROUP BY {keys} {least}),
g AS (SELECT *, CASE WHEN sd > 0 AND is_n > 1 THEN {p_sql('(a / (sd / sqrt(is_n)))', '(is_n - 1)')} END AS is_p FROM h)"""


def _judged(df, *keys):
    return S.rounded(df.select(*keys, "is_n", "is_p", "fdr_pass"), 8)


@query("edge_p_values", f"""WITH {S.EVENTS_SQL}, {_KISH.replace('symbol', 'nation')}, b AS (SELECT e.nation, count(*) AS n, any_value(n_eff) AS n_eff, avg(target) / (stddev_samp(target) / sqrt(any_value(n_eff))) AS t FROM e JOIN kn ON e.nation = kn.nation GROUP BY e.nation),
q AS (SELECT *, greatest(floor(n_eff) - 1, 1) AS nu FROM b) SELECT nation, n, round(n_eff, 1) AS n_eff, round(t, 6) AS t_stat, round({p_sql('t', 'nu')}, 8) AS p_value FROM q""")
def edge_p_values(spark, sf):
    return S.rounded(stats.edge_metrics(S.order_events(spark, sf), ["nation"], "target").select("nation", "n", "n_eff", "t_stat", "p_value"), 8, t_stat=6)


@query("calendar_fdr", f"WITH {S.EVENTS_SQL}, k AS ({_CALENDAR}), {_in_sample('k', 'condition', 'HAVING count(*) >= 50')}, {fdr_sql('g', 'condition', 'is_p')} SELECT condition, is_n, round(is_p, 8) AS is_p, fdr_pass FROM v")
def calendar_fdr(spark, sf):
    return _judged(discovery.calendar_scan(S.order_events(spark, sf), "target", T), "condition")


@query("sequence_fdr", f"""WITH {S.EVENTS_SQL}, o AS (SELECT *, CASE WHEN target > 0 THEN 'W' ELSE 'L' END AS o FROM e), hh AS (SELECT *, lag(o, 1) OVER w AS h1, lag(o, 2) OVER w AS h2, lag(o, 3) OVER w AS h3 FROM o WINDOW w AS (PARTITION BY symbol ORDER BY date, event_id)),
k AS (SELECT 'last 1 outcomes = ' || h1 AS pattern, target AS ret, date FROM hh UNION ALL SELECT 'last 2 outcomes = ' || h2 || h1, target, date FROM hh UNION ALL SELECT 'last 3 outcomes = ' || h3 || h2 || h1, target, date FROM hh),
kk AS (SELECT * FROM k WHERE pattern IS NOT NULL), {_in_sample('kk', 'pattern', 'HAVING count(*) >= 50')}, {fdr_sql('g', 'pattern', 'is_p')} SELECT pattern, is_n, round(is_p, 8) AS is_p, fdr_pass FROM v""")
def sequence_fdr(spark, sf):
    return _judged(discovery.sequence_patterns(S.order_events(spark, sf), "target", 3, T, order=("date", "event_id")), "pattern")


@query("anomaly_fdr", f"""WITH {S.EVENTS_SQL}, z AS (SELECT *, CASE WHEN count(qty) OVER w >= 20 THEN (qty - avg(qty) OVER w) / nullif(stddev_samp(qty) OVER w, 0) END AS z FROM e WINDOW w AS (PARTITION BY symbol ORDER BY date, event_id ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
k AS (SELECT date, target AS ret, unnest(['qty_lag1', 'qty_lag2', 'qty_lag3']) AS anomaly, unnest([abs(lag(z, 1) OVER w) >= 1.5, abs(lag(z, 2) OVER w) >= 1.5, abs(lag(z, 3) OVER w) >= 1.5]) AS hit FROM z WINDOW w AS (PARTITION BY symbol ORDER BY date, event_id)),
kk AS (SELECT * FROM k WHERE hit), {_in_sample('kk', 'anomaly', 'HAVING count(*) >= 50')}, {fdr_sql('g', 'anomaly', 'is_p')} SELECT anomaly, is_n, round(is_p, 8) AS is_p, fdr_pass FROM v""")
def anomaly_fdr(spark, sf):
    return _judged(discovery.anomaly_precursors(S.order_events(spark, sf), "target", ["qty"], 1.5, T, order=("date", "event_id")), "anomaly")


@query("threshold_fdr", f"""WITH {S.EVENTS_SQL}, {_LONG}, lt AS (SELECT * FROM l WHERE {_TRAIN}), n AS (SELECT factor, list_sort(list_distinct([{', '.join(f'quantile_cont(x, {i / 20})' for i in range(1, 20))}])) AS cuts FROM lt GROUP BY factor HAVING count(*) >= 100 AND count(DISTINCT x) >= 5),
c AS (SELECT factor, unnest(cuts) AS cut, unnest(range(len(cuts))) AS k FROM n),
s AS (SELECT c.factor, cut, k, avg(ret) FILTER (WHERE x > cut) - avg(ret) FILTER (WHERE x <= cut) AS diff FROM c JOIN lt ON lt.factor = c.factor GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE x > cut) >= 50 AND count(*) FILTER (WHERE x <= cut) >= 50),
b AS (SELECT factor, cut, diff FROM s QUALIFY row_number() OVER (PARTITION BY factor ORDER BY round(abs(diff), 9) DESC, k) = 1),
m AS (SELECT l.factor, ret, date FROM l JOIN b ON l.factor = b.factor AND CASE WHEN diff > 0 THEN x > cut ELSE x <= cut END), {_in_sample('m', 'factor')}, {fdr_sql('g', 'factor', 'is_p')} SELECT factor, is_n, round(is_p, 8) AS is_p, fdr_pass FROM v""")
def threshold_fdr(spark, sf):
    return _judged(discovery.optimal_thresholds(S.order_events(spark, sf), "target", S.FACTORS, T, least_kinds=5), "factor")


@query("regime_fdr", f"""WITH {S.EVENTS_SQL}, rr AS (SELECT 'early' AS regime, * FROM e WHERE day(date) <= 10 UNION ALL SELECT 'late', * FROM e WHERE day(date) >= 20),
l AS (SELECT regime, 'qty' AS factor, qty AS x, target AS ret, date FROM rr UNION ALL SELECT regime, 'acctbal', acctbal, target, date FROM rr),
md AS (SELECT regime, factor, quantile_cont(x, 0.5) AS med FROM l WHERE {_TRAIN} GROUP BY 1, 2), hf AS (SELECT l.*, CASE WHEN x > med THEN '>' ELSE '<=' END AS side FROM l JOIN md USING (regime, factor)),
k AS (SELECT regime, factor, side, ret, date FROM hf UNION ALL SELECT regime, '(baseline)', '', target, date FROM rr), {_in_sample('k', 'regime, factor, side')},
b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY regime, factor ORDER BY abs(a) DESC, side) = 1 AND min(is_n) OVER (PARTITION BY regime, factor) >= 50), {fdr_sql('b', 'regime, factor', 'is_p')}
SELECT regime, trim(factor || ' ' || side) AS factor, is_n, round(is_p, 8) AS is_p, fdr_pass FROM v""")
def regime_fdr(spark, sf):
    both = {"early": F.day("date") <= 10, "late": F.day("date") >= 20}
    out = discovery.regime_conditional(S.order_events(spark, sf), "target", ["qty", "acctbal"], (both, both), T)
    return _judged(out.withColumn("factor", F.regexp_replace("factor", r" [0-9.e+-]+$", "")), "regime", "factor")


@query("lead_lag_fdr", f"""WITH {S.EVENTS_SQL}, s AS (SELECT * FROM e WHERE {_TRAIN}), y AS (SELECT target AS y, unnest([1, 2, 3]) AS k, unnest([lag(qty, 1) OVER w, lag(qty, 2) OVER w, lag(qty, 3) OVER w]) AS x FROM s WINDOW w AS (PARTITION BY symbol ORDER BY date, event_id)),
rk AS (SELECT k, rank() OVER (PARTITION BY k ORDER BY x) + (count(*) OVER (PARTITION BY k, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY k ORDER BY y) + (count(*) OVER (PARTITION BY k, y) - 1) / 2.0 AS b FROM y WHERE x IS NOT NULL),
i AS (SELECT CAST(k AS INTEGER) AS extra_lag_days, corr(a, b) AS ic, count(*) AS n FROM rk GROUP BY 1), j AS (SELECT *, ic * sqrt((n - 2) / (1 - ic * ic)) AS t FROM i), g AS (SELECT *, {p_sql('t', '(n - 2)')} AS is_p FROM j), {fdr_sql('g', 'extra_lag_days', 'is_p')}
SELECT extra_lag_days, n, round(t, 6) AS t_stat, round(is_p, 8) AS is_p, fdr_pass FROM v""")
def lead_lag_fdr(spark, sf):
    out = discovery.lead_lag(S.order_events(spark, sf), "target", ["qty"], 3, T, order=("date", "event_id"))
    return S.rounded(out.select("extra_lag_days", "n", "t_stat", "is_p", "fdr_pass"), 8, t_stat=6)


#: Level 1 with its p values: buckets and tails of the training events, each with its effective number of events.
_LEVEL1 = f"""{_LONG.replace("'acctbal' AS factor", "event_id, 'acctbal' AS factor").replace("target, 'qty'", "target, event_id, 'qty'").replace("target, 'disc'", "target, event_id, 'disc'").replace("target, 'n_items'", "target, event_id, 'n_items'")},
lt AS (SELECT * FROM l WHERE {_TRAIN}), {_BUCKETS.format(t='lt')},
qt AS (SELECT factor, quantile_cont(x, 0.95) AS a, quantile_cont(x, 0.99) AS b, quantile_cont(x, 0.05) AS c, quantile_cont(x, 0.01) AS d FROM lt GROUP BY factor HAVING count(DISTINCT x) > 20),
mm AS (SELECT factor, 'q' || k AS bucket, edges[k] AS lo, edges[k + 1] AS hi, ret, date FROM bm UNION ALL SELECT factor, 'tail_top5', a, 1e300, ret, date FROM lt JOIN qt USING (factor) WHERE x >= a UNION ALL SELECT factor, 'tail_top1', b, 1e300, ret, date FROM lt JOIN qt USING (factor) WHERE x >= b
UNION ALL SELECT factor, 'tail_bot5', -1e300, c, ret, date FROM lt JOIN qt USING (factor) WHERE x <= c UNION ALL SELECT factor, 'tail_bot1', -1e300, d, ret, date FROM lt JOIN qt USING (factor) WHERE x <= d),
kd AS (SELECT factor, bucket, lo, hi, date, count(*) AS n, sum(ret) AS s, sum(ret * ret) AS q FROM mm GROUP BY ALL),
ks AS (SELECT factor, bucket, lo, hi, CAST(sum(n) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS days, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM kd GROUP BY ALL),
kn AS (SELECT *, s / n AS mean, q - s * s / n AS total, CASE WHEN n < 30 OR n / days <= 1.5 OR q - s * s / n <= 0 THEN n ELSE greatest(least(n / (1 + (n / days - 1) * greatest(0.0, least(0.99, ((b - s * s / n) / (q - s * s / n) - days / n) / (1 - days / n)))), n), days) END AS n_eff FROM ks WHERE bucket LIKE 'q%' OR n >= 30),
kb AS (SELECT factor, max(mean) - min(mean) AS spread, arg_max(bucket, mean) AS best_bucket, arg_max(lo, mean) AS lo, arg_max(hi, mean) AS hi, arg_max(n, mean) AS best_n, arg_max(n_eff, mean) AS ne, arg_max(mean / (sqrt(total / (n - 1)) / sqrt(n_eff)), mean) AS t FROM kn GROUP BY factor),
kp AS (SELECT *, {p_sql('t', 'greatest(floor(ne) - 1, 1)')} AS best_p FROM kb), {fdr_sql('kp', 'factor', 'best_p')}"""


@query("single_factor_fdr", f"WITH {S.EVENTS_SQL}, {_LEVEL1} SELECT factor, best_bucket, CAST(best_n AS BIGINT) AS best_n, round(best_p, 8) AS best_p, fdr_pass FROM v")
def single_factor_fdr(spark, sf):
    out = discovery.single_factors(S.order_events(spark, sf), "target", S.FACTORS, T)
    return S.rounded(out.select("factor", "best_bucket", "best_n", "best_p", "fdr_pass"), 8)


@query("level2_combinations", f"""WITH {S.EVENTS_SQL}, {_LEVEL1}, sel AS (SELECT factor, best_bucket, lo, hi, row_number() OVER (ORDER BY spread DESC, factor) AS place FROM v WHERE fdr_pass OR (SELECT count(*) FROM v WHERE fdr_pass) < 2),
w AS (SELECT l.event_id, l.factor, place, ret, date FROM l JOIN sel ON l.factor = sel.factor AND CASE WHEN best_bucket LIKE 'tail_top%' THEN x >= lo WHEN best_bucket LIKE 'tail_bot%' THEN x <= hi ELSE x > lo AND x <= hi END),
cb AS (SELECT a.factor || ' AND ' || b.factor AS combo, 2 AS n_factors, a.ret, a.date FROM w a JOIN w b ON a.event_id = b.event_id AND a.place < b.place
UNION ALL SELECT a.factor || ' AND ' || b.factor || ' AND ' || c.factor, 3, a.ret, a.date FROM w a JOIN w b ON a.event_id = b.event_id AND a.place < b.place JOIN w c ON c.event_id = b.event_id AND b.place < c.place)
SELECT combo, n_factors, count(*) FILTER (WHERE {_TRAIN}) AS is_n, round(avg(ret) FILTER (WHERE {_TRAIN}), 6) AS is_mean, count(*) FILTER (WHERE {_TEST}) AS oos_n, round(avg(ret) FILTER (WHERE {_TEST}), 6) AS oos_mean FROM cb GROUP BY combo, n_factors HAVING count(*) FILTER (WHERE {_TRAIN}) >= 50""")
def level2(spark, sf):
    e = S.order_events(spark, sf)
    out = discovery.combinations_of(e, "target", discovery.single_factors(e, "target", S.FACTORS, T), T)
    plain = F.regexp_replace("combo", r" in \([^]]*\]", "")
    return S.rounded(out.select(plain.alias("combo"), "n_factors", "is_n", "is_mean", F.coalesce("oos_n", F.lit(0)).cast("long").alias("oos_n"), "oos_mean"))


# The 0.98 and 1 - 1 / (50 e) points of the normal distribution, for 50 trials.
_LUCK = (1 - 0.5772156649) * 2.0537489106318225 + 0.5772156649 * 2.4393139538578916


@query("deflated_sharpe", f"""WITH {S.RULES_SQL}, c AS (SELECT rule, net - avg(net) OVER (PARTITION BY rule) AS d, net FROM m), o AS (SELECT rule, count(*) AS n, avg(net) / stddev_samp(net) AS sr, avg(d * d * d) / power(avg(d * d), 1.5) AS skew, avg(d * d * d * d) / power(avg(d * d), 2) AS kurt FROM c GROUP BY rule),
z AS (SELECT *, CASE WHEN n >= 50 THEN (sr - {_LUCK} / sqrt(n - 1)) / sqrt(greatest(1e-12, (1 - skew * sr + (kurt - 1) / 4 * sr * sr) / (n - 1))) END AS x FROM o),
t AS (SELECT *, 1 / (1 + 0.2316419 * abs(x)) AS t FROM z), u AS (SELECT *, 0.3989422804014327 * exp(-x * x / 2) * (((((1.330274429 * t - 1.821255978) * t + 1.781477937) * t - 0.356563782) * t + 0.319381530) * t) AS u FROM t)
SELECT rule, n, round(sr, 6) AS sr, round(x, 4) AS dsr_z, round(CASE WHEN x >= 0 THEN 1 - u ELSE u END, 4) AS dsr, coalesce(round(CASE WHEN x >= 0 THEN 1 - u ELSE u END, 4) > 0.95, false) AS dsr_pass FROM u""")
def deflated_sharpe(spark, sf):
    return S.rounded(validation.deflated_sharpe(S.rule_members(spark, sf), 50).select("rule", "n", "sr", "dsr_z", "dsr", "dsr_pass"), sr=6, dsr_z=4, dsr=4)


@query("confirmed_rules", f"""WITH {S.RULES_SQL}, mm AS (SELECT rule, date, net + 0.1 * length(rule) AS net FROM m), b AS (SELECT rule, {', '.join(f"CASE WHEN count(*) FILTER (WHERE date > DATE '{c}') >= 20 AND avg(net) FILTER (WHERE date > DATE '{c}') > 0 THEN 1 ELSE 0 END AS p{i}" for i, c in enumerate(_CUTS))} FROM mm GROUP BY rule)
SELECT rule, CASE WHEN rule IN ('rich', 'bulk') THEN 'GOLD' ELSE 'PLATINUM' END AS grade FROM b WHERE p0 + p1 + p2 >= 2 AND rule <> 'monday' AND rule <> 'poor'""")
def confirmed(spark, sf):
    m = S.rule_members(spark, sf).withColumn("net", F.col("net") + 0.1 * F.length("rule"))
    grades = m.select("rule").distinct().withColumn("grade", F.when(F.col("rule").isin("rich", "bulk"), "GOLD").when(F.col("rule") == "monday", "SILVER").otherwise("PLATINUM"))
    family = m.select("rule").distinct().withColumn("spa_confirmed", F.col("rule") != "poor")
    return confirmed_rules(grades, validation.boundaries(m, T), family).select("rule", "grade")


@query("net_of_costs", f"WITH {S.EVENTS_SQL} SELECT event_id, round(target - CASE WHEN n_items > 2 THEN n_items / 100 ELSE 0.06 END, 9) AS net FROM e")
def net_of_costs(spark, sf):
    e = S.order_events(spark, sf)
    cost = F.when(F.col("n_items") > 2, F.col("n_items") / 100)
    return S.rounded(e.select("event_id", stats.net(F.col("target"), cost).alias("net")), 9)


@query("rolling_sum", f"WITH {S.DAYS_SQL} SELECT symbol, date, CASE WHEN count(volume) OVER w = 10 THEN sum(volume) OVER w END AS v FROM d WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)", dates=("date",))
def rolling_sum_query(spark, sf):
    from tidemark.functions.columns import rolling_sum, series

    return S.order_days(spark, sf).select("symbol", "date", rolling_sum(F.col("volume"), series(), 10).alias("v"))


@query("global_rank", f"WITH {S.EVENTS_SQL}, k AS (SELECT event_id, CASE WHEN n_items <> 2 THEN disc END AS x FROM e) SELECT event_id, CASE WHEN x IS NOT NULL THEN round((rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0) / count(x) OVER (), 9) END AS r FROM k")
def global_rank(spark, sf):
    e = S.order_events(spark, sf).select("event_id", F.when(F.col("n_items") != 2, F.col("disc")).alias("x"))
    return S.rounded(stats.ranked(e, {"r": "x"}, share=True).select("event_id", "r"), 9)


@query("global_rank_ic", f"""WITH {S.EVENTS_SQL}, r AS (SELECT rank() OVER (ORDER BY qty) + (count(*) OVER (PARTITION BY qty) - 1) / 2.0 AS a, rank() OVER (ORDER BY target) + (count(*) OVER (PARTITION BY target) - 1) / 2.0 AS b FROM e) SELECT round(corr(a, b), 6) AS ic, count(*) AS n FROM r""")
def global_rank_ic(spark, sf):
    from tidemark.operators.models import prediction_ic

    return S.rounded(prediction_ic(S.order_events(spark, sf).withColumn("prediction", F.col("qty")), "target"))


@query("keep_last_per_key", f"WITH {S.DAYS_SQL} SELECT symbol, date, o_totalprice AS close FROM d0 QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY o_orderkey DESC) = 1", dates=("date",))
def keep_last(spark, sf):
    from tidemark.sources.readers import last_of

    o, c = S.tables(spark, sf, "orders", "customer")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("c_mktsegment").alias("symbol"), F.to_date("o_orderdate").alias("date"), "o_orderkey", F.col("o_totalprice").alias("close"))
    return last_of(rows, ["symbol", "date"], "o_orderkey").select("symbol", "date", "close")


@query("null_group_medians", f"""WITH {S.DAYS_SQL}, h AS (SELECT symbol, date, CASE WHEN volume > 1 THEN close END AS close FROM d)
SELECT a.symbol, a.date, (SELECT quantile_cont(b.close, 0.5) FROM h b WHERE b.date = a.date AND b.symbol <> a.symbol) AS others FROM h a""", dates=("date",))
def null_group_medians(spark, sf):
    d = S.order_days(spark, sf).withColumn("close", F.when(F.col("volume") > 1, F.col("close")))
    return joins.leave_one_out_median(d, ["date"], "close", "others").select("symbol", "date", "others")
