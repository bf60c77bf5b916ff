"""Operators on small hand-made cases, and properties that must hold on any input."""

import datetime as dt
import functools
import itertools
import math
import random
import time
from statistics import median

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.operators import audit, discovery, features, formulas, joins, labels, microstructure, portfolio, stats, validation

DAY = dt.date(2021, 1, 4)


def days(n, start=DAY):
    return [start + dt.timedelta(days=i) for i in range(n)]


def test_quintile_edges(spark):
    long = spark.createDataFrame([("f", float(i), 0.0, DAY) for i in range(10)] + [("g", float(v), 0.0, DAY) for v in (0, 1, 1, 1, 2, 3, 4, 4)], "factor string, x double, ret double, date date")
    got = {(r.factor, r.x): (r.lo, r.hi) for r in stats.bucket_members(long, 5, tails=False).collect()}
    assert got["f", 0.0] == pytest.approx((0, 1.8)) and got["f", 1.0] == pytest.approx((0, 1.8)) and got["f", 2.0] == pytest.approx((1.8, 3.6)) and got["f", 9.0] == pytest.approx((7.2, 9))
    assert got["g", 1.0] == pytest.approx((0, 1)) and got["g", 2.0] == pytest.approx((1, 2.2)) and got["g", 4.0] == pytest.approx((3.6, 4))


def test_effective_n_is_between_days_and_events(spark):
    rng = random.Random(0)
    rows = [(k, d, rng.gauss(shift, 1)) for k in range(4) for d, shift in zip(days(30), [rng.gauss(0, k) for _ in range(30)], strict=True) for _ in range(rng.randrange(1, 6))]
    df = spark.createDataFrame(rows, "k int, date date, ret double")
    n = {r.k: (r.n, r.d) for r in df.groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("date").alias("d")).collect()}
    for r in stats.effective_n(df, ["k"]).collect():
        assert n[r.k][1] <= r.n_eff <= n[r.k][0]


def test_false_discovery_is_monotone_and_exact(spark):
    rng = random.Random(3)
    p = [rng.random() ** 3 for _ in range(60)] + [None, None]
    df = spark.createDataFrame(list(enumerate(p)), "i int, p double")
    got = {r.i: r.fdr_pass for r in stats.benjamini_hochberg(df, "p", order=["i"]).collect()}
    known = sorted(v for v in p if v is not None)
    last = max((k for k, v in enumerate(known, 1) if v <= 0.05 * k / len(known)), default=0)
    assert {i for i, ok in got.items() if ok} == {i for i, v in enumerate(p) if v is not None and v in known[:last]}


def test_leave_one_out_median(spark):
    rng = random.Random(5)
    rows = [(g, i, rng.choice([None, float(rng.randrange(6))])) for g in range(12) for i in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, "g int, i int, x double")
    got = {(r.g, r.i): r.m for r in joins.leave_one_out_median(df, ["g"], "x", "m").collect()}
    for g, i, _ in rows:
        others = [x for h, j, x in rows if h == g and j != i and x is not None]
        assert got[g, i] == (median(others) if others else None)


def test_asof_carries_rows_even_without_value(spark):
    left = spark.createDataFrame([(d,) for d in days(6)], "date date")
    series = spark.createDataFrame([(days(6)[1], 5.0), (days(6)[3], None)], "date date, v double")
    got = [r.v for r in joins.asof(left, series, ["v"]).orderBy("date").collect()]
    assert got == [None, 5.0, 5.0, None, None, None]
    strict = [r.v for r in joins.asof(left, series, ["v"], strict=True).orderBy("date").collect()]
    assert strict == [None, None, 5.0, 5.0, None, None]


def minute_day(spark, bars, symbol="A", day="2021-01-04"):
    rows = [(symbol, f"{day} {9 + (15 + i) // 60:02d}:{(15 + i) % 60:02d}:00", *map(float, b)) for i, b in enumerate(bars)]
    df = spark.createDataFrame(rows, "symbol string, t string, open double, high double, low double, close double, volume double")
    return df.select("symbol", F.to_timestamp_ntz("t").alias("ts"), "open", "high", "low", "close", "volume")


@pytest.mark.parametrize(
    ("path", "direction", "hit", "ret"),
    [
        ([(100, 102.5, 99.9, 102, 1)], 1, 1, 2.0),
        ([(100, 100.5, 98.5, 99, 1)], 1, -1, -1.0),
        ([(100, 103, 98, 100, 1)], 1, -1, -1.0),  # both in one bar: the stop counts
        ([(100, 100.2, 99.8, 100.1, 1)], 1, 0, 0.1),
        ([(100, 100.2, 97.5, 98, 1)], -1, 1, 2.0),
        ([], 1, None, None),
    ],
)
def test_triple_barrier(spark, path, direction, hit, ret):
    bars = labels.numbered(minute_day(spark, [(100, 100, 100, 100, 1), *path]))
    entry = spark.createDataFrame([("A", DAY, 0, float(direction), 1.0)], "symbol string, date date, entry int, direction double, atr_pct double")
    (r,) = labels.triple_barrier(bars, entry).collect()
    assert r.tb_hit == hit and (r.tb_ret is None if ret is None else r.tb_ret == pytest.approx(ret))


def test_features_look_back_only(spark):
    """A change of later rows leaves a day's factors as they were."""
    rng = random.Random(2)
    rows = [("A", d, *(round(100 + rng.random() * 5, 3) for _ in range(4)), 1000.0 + rng.randrange(100)) for d in days(80)]
    schema = "symbol string, date date, open double, high double, low double, close double, volume double"
    names = ["ret_1d", "ret_5d", "atr14_pct", "rv20", "rvol_20d", "zscore_20d", "up_streak", "range_compression"]
    cut = days(80)[70]
    changed = [r if r[1] <= cut else (*r[:2], 1.0, 2.0, 0.5, 1.5, 9.0) for r in rows]
    same_day = [r if r[1] != cut else (*r[:3], 999.0, 1.0, 555.0, 5e6) for r in changed]  # also the day's own high, low, close, volume
    a, b = ({r.date: tuple(r[n] for n in names) for r in features.price_volume(spark.createDataFrame(x, schema)).filter(F.col("date") <= cut).collect()} for x in (rows, same_day))
    assert a == b


def test_streak_as_coded(spark):
    closes = [5, 5, 6, 7, 7, 6, 8, 9]
    df = spark.createDataFrame([("A", d, 1.0, 1.0, 1.0, float(c), 1.0) for d, c in zip(days(8), closes, strict=True)], "symbol string, date date, open double, high double, low double, close double, volume double")
    got = [r.up_streak for r in features.price_volume(df).orderBy("date").collect()]
    assert got == [None, 0, 0, 1, 2, 0, 0, 1]


def test_microstructure_against_numpy(spark):
    rng = np.random.default_rng(3)
    close = np.round(100 + np.cumsum(rng.choice([-0.1, 0, 0.1], 90)), 2)
    bars = [(c, c + 0.1, c - 0.1, c, v) for c, v in zip(close, rng.integers(1, 50, 90), strict=True)]
    (r,) = microstructure.daily_measures(minute_day(spark, bars)).collect()
    dp = np.diff(close)
    cov = np.cov(dp[1:], dp[:-1])[0, 1]
    assert r.ms_roll_spread == pytest.approx(0 if cov >= 0 else 2 * np.sqrt(-cov) / np.median(close) * 100)
    moves = np.sign(dp[np.abs(dp) > 1e-12])
    runs = pd.Series([len(list(g)) for _, g in itertools.groupby(moves)]).value_counts(normalize=True)
    assert r.ms_run_entropy == pytest.approx(-(runs * np.log2(runs)).sum())
    assert 0 <= r.ms_vpin <= 1 and r.ms_amihud > 0


def test_audit_finds_jumps_stale_runs_and_late_starts(spark):
    s = Settings()
    rows = [("A", d, 100.0, 1.0, 1.0, 100.0 + i, 10.0) for i, d in enumerate(days(10))]
    rows[5] = ("A", days(10)[5], 200.0, 1.0, 1.0, 105.0, 0.0)
    rows += [("B", d, 50.0, 1.0, 1.0, 50.0, 10.0) for d in days(9, DAY + dt.timedelta(days=500))]
    daily = spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")
    actions = spark.createDataFrame([("A", days(10)[6], "Face_Value_Change")], "symbol string, date date, type string")
    checked = audit.checks(daily, actions, s)
    report = {(r.symbol, r.issue): r for r in audit.issues(checked, universe_known=False, s=s).collect()}
    assert report["A", "explained_corporate_action_jump"].severity == "info"
    assert report["A", "zero_volume_days"].detail == "1 days" and report["B", "stale_price_runs"].detail.startswith("4 days")
    assert "1/2 symbols" in report["*UNIVERSE*", "SURVIVORSHIP_RISK_no_pit_universe_file"].detail
    assert audit.quarantined(checked).count() == 1 + 4
    assert audit.issues(audit.checks(daily, None, s), s=s).filter("issue LIKE 'UNEXPLAINED%'").first().severity == "CRITICAL"


def test_rule_strings(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, None), (None, 1.0)], "a double, b double")
    check = lambda rule: [r[0] for r in df.select(discovery.rule_condition(rule, df.columns)).collect()]
    assert check("a <= 1.5 AND b > 2") == [True, False, False]
    assert check("a in (0.5, 1.0]") == [True, False, False] and check("a in 2") == [False, True, False]
    assert discovery.rule_condition("c > 1", df.columns) is None and discovery.rule_condition("a ~ 1", df.columns) is None and discovery.rule_condition("a > x", df.columns) is None


def test_factor_columns_leave_outcomes_out(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0, "s", 2.0)], "f double, cont_30m double, tb_ret double, symbol string, cost_pct double")
    assert discovery.factor_columns(df, ["cont_30m"]) == ["f"]


def members(spark, series, start=DAY):
    rows = [(n, start + dt.timedelta(days=i), float(v), True) for n, xs in series.items() for i, v in enumerate(xs)]
    return spark.createDataFrame(rows, "rule string, date date, net double, chosen boolean")


def test_resampling_tells_signal_from_noise(spark):
    rng = np.random.default_rng(1)
    m = members(spark, {"good": rng.normal(1.0, 1, 300), "noise": rng.normal(0, 1, 300), "flat": np.zeros(300)})
    ci = {r.rule: r for r in validation.bootstrap_ci(m, Settings(n_bootstrap=200)).collect()}
    mean = m.filter("rule = 'good'").agg(F.avg("net")).first()[0]
    assert ci["good"].boot_pass and not ci["noise"].boot_pass and ci["good"].boot_ci_5_95.lo < mean < ci["good"].boot_ci_5_95.hi
    spa = {r.rule: r for r in validation.spa_stepdown(m, replicates=200).collect()}
    assert spa["good"].spa_confirmed and not spa["noise"].spa_confirmed and not spa["flat"].spa_confirmed and spa["flat"].spa_p is None
    again = {r.rule: r for r in validation.bootstrap_ci(m.repartition(7), Settings(n_bootstrap=200)).collect()}
    assert again == ci


def test_permutation_tells_a_rule_from_chance(spark):
    rng = np.random.default_rng(2)
    rows = []
    for d in days(80):
        for k in range(6):
            for rule, lift in (("good", 1.0), ("chance", 0.0)):
                rows.append((rule, d, float(rng.normal() + lift * (k == 0)), k == 0))
    m = spark.createDataFrame(rows, "rule string, date date, net double, chosen boolean")
    got = {r.rule: r for r in validation.permutation_test(m, Settings(n_permutations=60)).collect()}
    assert got["good"].perm_pass and got["good"].n_selected == 80 and not got["chance"].perm_pass


def test_drawn_sums_are_of_any_set_alike():
    rng = np.random.default_rng(4)
    for n, cells in ((6, 1 << 21), (7, 64)):
        for k in range(n + 1):
            kinds, times = np.unique(validation._drawn_sums(rng, 2.0 ** np.arange(n), np.full(4000, k), cells), return_counts=True)
            due = 4000 / math.comb(n, k)
            assert len(kinds) == math.comb(n, k) and abs(times - due).max() < 6 * math.sqrt(due) + 1e-9
    x = rng.normal(size=900)
    for k in (2, 100, 450, 800):
        got = validation._drawn_sums(rng, x, np.full(4000, k))
        sd = math.sqrt(k * (1 - k / 900) * x.var(ddof=1))
        assert abs(got.mean() - k * x.mean()) < 5 * sd / math.sqrt(4000) and abs(got.std() / sd - 1) < 0.06


def test_permutation_in_time_on_large_days(spark):
    """Half a million events of one rule: sorting them all for each replicate took minutes. All of them alike are no evidence."""
    day = F.date_add(F.lit(DAY), (F.col("id") % 50).cast("int"))
    rows = spark.range(500_000).select(day.alias("date"), F.rand(1).alias("noise"), (F.col("id") % 3 == 0).alias("chosen"))
    lift = {"good": F.col("noise") + 0.01 * F.col("chosen").cast("int"), "chance": F.col("noise"), "flat": F.lit(0.1)}
    m = functools.reduce(lambda a, b: a.union(b), (rows.select(F.lit(n).alias("rule"), "date", c.alias("net"), "chosen") for n, c in lift.items())).persist()
    m.count()
    began = time.monotonic()
    got = {r.rule: r for r in validation.permutation_test(m, Settings(n_permutations=500)).collect()}
    assert time.monotonic() - began < 60
    assert got["good"].perm_pass and not got["chance"].perm_pass and got["flat"].perm_p == 1.0 and got["good"].n_selected == 166667
    again = {r.rule: r for r in validation.permutation_test(m.repartition(5, "net"), Settings(n_permutations=500)).collect()}
    assert again == got
    m.unpersist()


def test_stationary_means_by_running_sums():
    """The same law as means over the places of a sample, whatever the length of the series and of its runs."""
    rng = np.random.default_rng(6)
    for n, block in ((3, 20), (80, 20), (300, 5), (50, 1)):
        x = np.sort(rng.normal(size=n))
        sums = np.concatenate([[0.0], np.cumsum(np.tile(x, 2))])
        a = np.array([validation._stationary_mean(rng, sums, n, block) for _ in range(4000)])
        b = np.array([x[validation._stationary(rng, n, block, n)].mean() for _ in range(4000)])
        assert abs(a.mean() - b.mean()) < 5 * b.std() / math.sqrt(2000) and abs(a.std() / b.std() - 1) < 0.1


def test_gauntlet_in_time_on_many_events(spark):
    day = F.date_add(F.lit(DAY), (F.col("id") % 400).cast("int"))
    rows = spark.range(800_000).select(day.alias("date"), F.randn(1).alias("noise"), (F.col("id") % 3 == 0).alias("chosen"))
    lift = {"good": F.col("noise") + 0.5 * F.col("chosen").cast("int"), "chance": F.col("noise") - 0.05}
    m = functools.reduce(lambda a, b: a.union(b), (rows.select(F.lit(n).alias("rule"), "date", c.alias("net"), "chosen") for n, c in lift.items())).persist()
    m.count()
    began = time.monotonic()
    got = {r.rule: r for r in validation.gauntlet(m, 20, Settings()).collect()}
    assert time.monotonic() - began < 60
    assert got["good"].grade == "PLATINUM" and got["good"].n_events == got["good"].n_selected == 266667
    assert got["chance"].grade == "REJECTED"
    m.unpersist()


def test_overfitting_probability_is_a_share(spark):
    rng = np.random.default_rng(3)
    noise = members(spark, {f"r{i}": rng.normal(0, 1, 160) for i in range(6)})
    (r,) = validation.cscv_pbo(noise).collect()
    assert 0 <= r.pbo <= 1
    (one,) = validation.cscv_pbo(members(spark, {"x": rng.normal(0, 1, 160)})).collect()
    assert one.pbo is None and one.pbo_pass
    best = members(spark, {"best": rng.normal(3, 1, 160), "worst": rng.normal(-3, 1, 160)})
    assert validation.cscv_pbo(best).first().pbo == 0.0


def test_book_caps_slots_and_fills_business_days(spark):
    rows = [("a", DAY, float(i)) for i in range(12)] + [("a", DAY + dt.timedelta(days=3), 5.0)]
    m = spark.createDataFrame(rows, "rule string, date date, net double").withColumn("event_id", F.col("net"))
    book = portfolio.combined_book(m, ["event_id"], Settings()).first()
    assert (book.n_trades_total, book.n_trades_capped_out, book.n_calendar_days, book.concurrency_max) == (13, 2, 4, 12)
    pnl = [r.pnl for r in portfolio.book_days(m, ["event_id"], Settings()).orderBy("date").collect()]
    assert pnl == pytest.approx([4.5, 0, 0, 0.5])


def test_formula_trees():
    f = formulas.parse("add(ts_mean5(qty), mul(a, neg(b)))")
    assert str(f) == "add(ts_mean5(qty), mul(a, neg(b)))" and f.size == 7 and f.depth == 4 and f.leaves() == {"qty", "a", "b"}
    for place, node in enumerate(f.nodes()):
        assert f.replaced(place, node) == f
    b = formulas.Breeder(["a", "b"], Settings())
    trees = [b.tree(4) for _ in range(50)]
    assert all(formulas.parse(str(t)) == t for t in trees) and all(b.crossed(t, trees[0]).size >= 1 and b.mutated(t).size >= 1 for t in trees)


def test_formula_windows(spark):
    rows = [("s", DAY + dt.timedelta(days=i), i, float(i * i % 7), 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "symbol string, date date, event_id int, x double, y double")
    texts = ["ts_mean5(ts_delta5(x))", "rank(x)", "add(ts_z10(x), ts_std10(x))", "ts_rank10(neg(x))"]
    out, names = formulas.evaluated(df, [formulas.parse(t) for t in texts])
    got = out.orderBy("event_id").toPandas()
    x = pd.Series([r[3] for r in rows])
    want = [x.diff(5).rolling(5).mean(), x.rank(pct=True), (x - x.rolling(10).mean()) / x.rolling(10).std() + x.rolling(10).std(), (-x).rolling(10).rank(pct=True)]
    for n, w in zip(names, want, strict=True):
        pd.testing.assert_series_equal(got[n].astype(float), w, check_names=False, rtol=1e-9)
