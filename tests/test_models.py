"""Models, clusters and evolved formulas on planted structure; what follows the gauntlet; the trade sheet from stored tables."""

import datetime as dt
import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.config import SETTINGS
from tidemark.operators import formulas, models, regimes, stats
from tidemark.plans import research, score
from tidemark.sources import readers, sinks

DAY = dt.date(2020, 1, 1)
S = replace(SETTINGS, train_end="2020-12-31", min_events=50, meta_min_events=100, n_permutations=60, n_bootstrap=100, boundary_dates=("2020-06-30", "2020-12-31", "2021-03-31"), gp_population=30, gp_generations=2, gp_max_depth=2)


@pytest.fixture(scope="module")
def panel(spark):
    """1800 events over 600 days and 3 symbols: the target is x * y plus noise, z is noise, w falls into two heaps."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(1800):
        x, y, z = rng.normal(size=3)
        w = float(rng.choice([-3.0, 3.0]) + rng.normal() * 0.1)
        rows.append((f"s{i % 3}", DAY + dt.timedelta(days=i // 3), i, float(x), float(y) if i % 50 else None, float(z), w, float(x * y + 0.3 * rng.normal() + (0.5 if w > 0 else -0.5)), 1e9))
    return spark.createDataFrame(rows, "symbol string, date date, event_id long, x double, y double, z double, w double, target double, open30_value double")


def test_boosted_trees_find_what_is_planted(panel):
    predicted, model, inputs = models.all_factors_model(panel, "target", ["x", "y", "z"], S, trees=25, least=(500, 200))
    ic = models.prediction_ic(predicted, "target").first()
    pdf = predicted.select("prediction", "target").toPandas()
    assert ic.ic == pytest.approx(pdf.prediction.rank().corr(pdf.target.rank())) and ic.n == len(pdf) and ic.ic > 0.5
    sides = {r.side: r.mean_ret for r in models.decile_report(predicted, "target").collect()}
    assert sides["top"] > 0.8 > -0.8 > sides["bottom"]
    importance = [r.factor for r in models.permutation_importance(predicted, model, inputs, ["x", "y", "z"], 2).collect()]
    assert importance[-1] == "z"
    assert models.all_factors_model(panel, "target", ["x"], S, least=(5000, 200)) is None


def test_clusters_are_the_heaps(panel):
    found = regimes.hidden_clusters(panel, "target", ["w", "z"], 2, S).collect()
    assert sum(r.is_n for r in found) == panel.filter("date <= '2020-12-31'").count()
    means = sorted((r.profile.split(",")[0], round(r.is_mean, 1)) for r in found)
    assert [m[0] for m in means] == ["w+", "w-"] and means[0][1] > 0.3 > -0.3 > means[1][1]


def test_market_regimes_follow_the_days(spark):
    rng = np.random.default_rng(2)
    state = [(i // 40) % 3 for i in range(360)]
    rows = [(DAY + dt.timedelta(days=i), *(float(s * 5 + rng.normal() * 0.2) for _ in range(3))) for i, s in enumerate(state) for _ in range(2)]
    days = spark.createDataFrame(rows, "date date, a double, b double, c double")
    found = regimes.market_regimes(days, ["a", "b", "c"], replace(S, train_end="2020-08-31")).toPandas().sort_values("date")
    assert len(found) == 360 and found.confidence.min() > 0.9
    assert pd.crosstab(found.regime, pd.Series(state, index=found.index)).gt(0).sum().eq(1).all()
    assert regimes.market_regimes(days, ["a", "b"], S) is None


def test_figures_of_second_opinions(spark):
    rng = np.random.default_rng(1)
    net, prob = rng.normal(0.1, 1, 200), rng.random(200)
    got = models.meta_figures(spark.createDataFrame(pd.DataFrame({"net": net, "prob": prob})), S).first()
    kept = prob >= S.meta_prob_threshold
    flat = np.where(kept, net, 0.0)
    want = (200, net.mean(), net[kept].mean(), kept.mean(), net.mean() / net.std() * math.sqrt(252), flat.mean() / flat.std() * math.sqrt(252), (np.clip(0.25 * (2 * prob - 1), 0, 1) * net).mean())
    assert (got.n_oos, got.oos_base_mean, got.oos_filtered_mean, got.oos_kept_frac, got.oos_base_sharpe, got.oos_filtered_sharpe, got.oos_kelly_mean) == pytest.approx(want)
    assert got.improves == (net[kept].mean() > net.mean() and flat.mean() >= 0.8 * net.mean())
    few = models.meta_figures(spark.createDataFrame([(1.0, 0.9), (-1.0, 0.2)], "net double, prob double"), S).first()
    assert few.oos_filtered_mean is None and not few.improves


def test_second_opinions_tell_good_events(spark, panel):
    members = panel.select(F.lit("r").alias("rule"), "event_id", (F.col("x") + 0.1 * F.col("z")).alias("net"))
    both = members.unionByName(members.limit(20).withColumn("rule", F.lit("few")))
    (got,) = models.run_meta_labels(panel, both, ["few", "r"], ["x", "y"], S, trees=10).collect()
    assert got.rule == "r" and got.improves and got.oos_filtered_mean > 0.5 and got.top_features.startswith("x")


def test_evolution_finds_the_product(panel):
    best = formulas.evolve(panel, "target", ["x", "y", "z"], s=S).collect()
    assert best and any({"x", "y"} <= formulas.parse(r.formula).leaves() and r.confirmed and abs(r.oos_ic) > 0.4 for r in best)
    flags = formulas.top_decile(panel, "mul(x, y)", 0.5).filter("chosen").agg(F.avg("target"), F.count("*")).first()
    assert flags[0] > 1 and 160 <= flags[1] <= 190


def test_ranks_in_cells_are_ranks(spark):
    rng = np.random.default_rng(3)
    x = np.where(rng.random(3000) < 0.1, None, np.round(rng.normal(size=3000), 1).astype(object))
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(x)], "i long, x double").repartition(5)
    got = stats.ranked(df, {"r": "x"}).orderBy("i").toPandas()
    want = pd.Series([np.nan if v is None else float(v) for v in x]).rank()
    pd.testing.assert_series_equal(got.r.astype(float), want, check_names=False)
    share = stats.ranked(df.filter("x IS NULL"), {"r": "x"}, share=True).agg(F.count("r")).first()[0]
    assert share == 0


@pytest.fixture(scope="module")
def results(spark, panel, tmp_path_factory):
    """A run's stored tables: two rules that pass, one that fails the gauntlet."""
    out = str(tmp_path_factory.mktemp("out"))
    p = panel.withColumns({"cost_pct": F.lit(0.05), "nifty_ret_5d": F.col("w"), "vix_level": F.col("w") * 2, "fii_net_5d": -F.col("w")})
    conditions = {"L1:w": F.col("w") > 0, "L6:mul(x, y)": F.col("x") * F.col("y") > 0, "L1:z": F.col("z") < 0}
    members = research.rule_members(p, "target", conditions)
    made = {}

    def keep(level, df, csv=False):
        if df is not None:
            sinks.write_parquet(df, f"{out}/gap_{level}")
            made[level] = spark.read.parquet(f"{out}/gap_{level}")
            if csv:
                sinks.write_csv(made[level], f"{out}/gap_{level}_csv", single=True)
        return made.get(level)

    grades = [("L1:w", "GOLD", 0.4), ("L6:mul(x, y)", "PLATINUM", 0.7), ("L1:z", "REJECTED", -0.1)]
    gauntlet = keep("gauntlet", spark.createDataFrame(grades, "rule string, grade string, net_mean double"))
    keep("single_factors", spark.createDataFrame([("w", 0.0, 9.0, "q2", True), ("z", -9.0, 0.0, "q1", True)], "factor string, best_lo double, best_hi double, best_bucket string, confirmed boolean"))
    research.judged(p, members.filter("chosen"), gauntlet, ["x", "y", "z"], keep, S, deep=False)
    return out, made


def test_what_follows_the_gauntlet(spark, results):
    out, made = results
    assert {"boundaries", "overlap", "pnl_correlation", "book", "daily_pnl", "capacity", "spa", "market_regimes", "edges_by_regime", "drift", "breadth"} <= set(made)
    for level in ("boundaries", "capacity", "spa", "drift"):
        assert {r.rule for r in made[level].collect()} == {"L1:w", "L6:mul(x, y)"}, level
    assert made["daily_pnl"].count() == readers.result_csv(spark, f"{out}/gap_daily_pnl_csv").count() > 400
    text = research.summary("gap", {"gauntlet": made["gauntlet"]})
    assert text.index("PLATINUM") < text.index("GOLD") < text.index("REJECTED")


def test_candidates_are_confirmed_and_survive_false_discovery_control(spark, panel):
    level1 = spark.createDataFrame([("x", 0.0, 9.0, "q2", True, True, 0.5), ("y", 0.0, 9.0, "q2", True, False, 0.9), ("z", 0.0, 9.0, "q2", False, True, 0.9), ("w", 0.0, 9.0, "q2", True, True, 0.6)], "factor string, best_lo double, best_hi double, best_bucket string, confirmed boolean, fdr_pass boolean, spread double")
    alphas = spark.createDataFrame([("mul(x, y)", 0.4, True), ("neg(z)", 0.1, False)], "formula string, oos_ic double, confirmed boolean")
    ruled, conditions = research.candidates(panel, level1, alphas, S)
    assert list(conditions) == ["L1:w", "L1:x", "L6:mul(x, y)"]
    taken = research.rule_members(ruled.withColumn("cost_pct", F.lit(0.0)), "target", conditions).filter("chosen").groupBy("rule").count().collect()
    assert {r.rule: r["count"] for r in taken}["L6:mul(x, y)"] == pytest.approx(177, abs=3)
    assert list(research.candidates(panel, level1, None, replace(S, gauntlet_top_single=1))[1]) == ["L1:w"]


def test_trade_sheet_from_stored_tables(spark, results):
    out, made = results
    rules = score.stored_rules(spark, out, "gap")
    assert {r.rule for r in rules.collect()} == {r.rule for r in made["spa"].filter("spa_confirmed").collect()} and score.stored_rules(spark, out, "reversion") is None
    rows = [("A", DAY, 1.0, 2.0, 3e8), ("B", DAY, -0.9, -2.0, None), ("C", DAY, 0.1, 2.0, 1e9), ("A", DAY + dt.timedelta(days=1), 2.0, 2.0, 1e9), ("D", DAY, -2.0, 1.0, 1e9)]
    frame = spark.createDataFrame(rows, "symbol string, date date, gap_pct double, w double, open30_value double")
    known = spark.createDataFrame([("L1:w", "GOLD", 0.4, True, 5e7), ("L1:z", "GOLD", 0.9, True, 5e7)], "rule string, grade string, net_mean double, drift_ok boolean, max_notional double")
    level1 = made["single_factors"]
    got = score.score_frame(frame, level1, known, "gap", DAY.isoformat(), s=S).collect()
    assert [(r.symbol, r.rule, r.factor_value, r.direction, r.expected_net_pct, r.grade, r.regime_ok, r.action) for r in got] == [("A", "L1:w", 2.0, 1.0, 0.4, "GOLD", None, "TRADE"), ("D", "L1:w", 1.0, -1.0, 0.4, "GOLD", None, "TRADE")]
    assert all(r.cost_pct > 0.03 and r.max_notional == 5e7 for r in got)
    away = spark.createDataFrame([("L1:w", False)], "rule string, regime_ok boolean")
    assert {r.action for r in score.score_frame(frame, level1, known, "gap", DAY.isoformat(), away, S).collect()} == {"DO_NOT_TRADE"}
    drifting = known.withColumn("drift_ok", F.lit(False))
    assert {r.action for r in score.score_frame(frame, level1, drifting, "gap", DAY.isoformat(), s=S).collect()} == {"DO_NOT_TRADE"}
    assert score.score_frame(frame, level1, known, "reversion", DAY.isoformat(), s=S).filter("symbol = 'C'").count() == 1
    home = {r.rule: r.regime_ok for r in score.home_regimes(spark, out, "gap", "2021-05-01").collect()}
    assert set(home) == {"L1:w", "L6:mul(x, y)"}


def test_trade_sheet_of_bars(spark, tmp_path, results):
    """From bars and stored tables to the sheet's file."""
    from tidemark.sources import synthetic

    root, out = f"{tmp_path}/market", f"{tmp_path}/out"
    synthetic.write_sample(spark, root, symbols=2, days=40)
    day = spark.read.parquet(f"{root}/nifty.parquet").agg(F.max(F.to_date("date"))).first()[0].isoformat()
    level1 = [("day_of_week", -1.0, 9.0, "q1", True)]
    tables = {
        "gauntlet": spark.createDataFrame([("L1:day_of_week", "GOLD", 0.4)], "rule string, grade string, net_mean double"),
        "boundaries": spark.createDataFrame([("L1:day_of_week", True)], "rule string, boundary_pass boolean"),
        "spa": spark.createDataFrame([("L1:day_of_week", True)], "rule string, spa_confirmed boolean"),
        "single_factors": spark.createDataFrame(level1, "factor string, best_lo double, best_hi double, best_bucket string, confirmed boolean"),
    }
    assert score.trade_sheet(spark, root, out, day) is None
    for level, df in tables.items():
        sinks.write_parquet(df, f"{out}/reversion_{level}")
    sheet = score.trade_sheet(spark, root, out, day)
    assert sorted(r.symbol for r in sheet.collect()) == ["TEST00", "TEST01"]
    assert readers.result_csv(spark, f"{out}/trade_sheet_{day}").count() == 2
