"""The research pipeline: bars to event panels, panels to tested rules, rules to reports and a trade sheet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import SETTINGS, Settings
from tidemark.operators import audit, bars, costs, discovery, features, formulas, hypotheses, joins, labels, microstructure, models, portfolio, regimes, validation
from tidemark.sources import readers, sinks

#: Symbols with fewer bars than this are left out of panels.
LEAST_BARS = 500
MARKET_WORDS = ("nifty", "sp500", "crude", "usdinr", "vix", "fii", "sector", "mkt_")
GAP_TARGET, MR_TARGET = "cont_30m", "revert_30m"


@dataclass(frozen=True)
class Panels:
    gap: DataFrame
    reversion: DataFrame
    report: DataFrame
    quarantine: DataFrame


def daily_frame(minute: DataFrame) -> DataFrame:
    return bars.to_daily(minute).join(bars.open_window(minute), ["symbol", "date"], "left")


def feature_frame(minute: DataFrame, reg: readers.Registry) -> DataFrame:
    """All factors of all symbols and days: one plan, one scan of the bars for each of its two branches."""
    daily = daily_frame(minute)
    frame = features.assemble(daily, reg).drop("open", "high", "low", "close", "volume", "open_volume")
    micro = microstructure.known_at_open(microstructure.daily_measures(minute))
    return frame.withColumnRenamed("open_value", "open30_value").join(micro, ["symbol", "date"], "left")


def build_panels(spark: SparkSession, root: str, symbols: list[str] | None = None, s: Settings = SETTINGS) -> Panels:
    """Event panels of both strategies, audited, inside the universe, with costs."""
    reg = readers.Registry(spark, root)
    minute = readers.minute_bars(spark, root, symbols)
    if minute is None:
        raise FileNotFoundError(f"no minute bars under {root}")
    large = minute.groupBy("symbol").agg(F.count("*").alias("_n")).filter(F.col("_n") >= LEAST_BARS).select("symbol")
    minute = minute.join(large, "symbol", "left_semi")
    universe = readers.universe(spark, root)
    checked = audit.checks(bars.to_daily(minute), reg.get("corporate_actions"), s)
    quarantine = audit.quarantined(checked)
    frame = feature_frame(minute, reg)

    def panel(outcomes: DataFrame, strategy: str) -> DataFrame:
        p = frame.join(outcomes, ["symbol", "date"])
        p = joins.in_universe(audit.apply_quarantine(p, quarantine), universe)
        p = p.withColumn("event_id", F.xxhash64("symbol", "date"))
        return costs.with_event_costs(p, strategy, s=s)

    gap = panel(labels.gap_go(minute, frame.select("symbol", "date", "gap_pct").filter("gap_pct IS NOT NULL"), s).drop("gap_pct"), "gap")
    reversion = panel(labels.mean_reversion(minute, s), "reversion")
    return Panels(gap, reversion, audit.issues(checked, universe is not None, s), quarantine)


def level1_condition(row) -> Column:
    """The condition of a level 1 result, by its exact edges."""
    from tidemark.operators.stats import inside

    return inside(F.col(row.factor), F.lit(row.best_lo), F.lit(row.best_hi), F.lit(row.best_bucket))


def rule_members(panel: DataFrame, target: str, conditions: dict[str, Column]) -> DataFrame:
    """(rule, symbol, date, event_id, open30_value, net, chosen) of all events for each rule: a few rules, so a few times the panel."""
    each = F.array(*(F.struct(F.lit(n).alias("rule"), F.coalesce(c, F.lit(False)).alias("chosen")) for n, c in conditions.items()))
    rows = panel.select("symbol", "date", "event_id", "open30_value", (F.col(target) - F.col("cost_pct")).alias("net"), F.explode(each).alias("r"))
    return rows.select("symbol", "date", "event_id", "open30_value", "net", "r.*")


def market_factors(factors: list[str]) -> list[str]:
    """Factors whose names contain a word of the market as a whole."""
    return [f for f in factors if any(w in f for w in MARKET_WORDS)]


#: Grades from the best to the worst, and those that are traded.
GRADES = ("PLATINUM", "GOLD", "SILVER", "REJECTED")
TRADED = GRADES[:2]


def run_strategy(panel: DataFrame, target: str, name: str, out: str, s: Settings = SETTINGS, deep: bool = True) -> dict[str, DataFrame]:
    """All levels on one panel; each result table is written under `out` and returned as read from there.

    Level 1 rules that are confirmed and survive false discovery control, and confirmed formulas, run the gauntlet. Its two best
    grades, if they also stand other cut dates, are the book: overlap, correlation, capacity, daily results, the family-wise test, second
    opinions, regimes, drift and breadth are about these.
    """
    spark = panel.sparkSession
    panel = panel.persist()
    targets = [c for c in panel.columns if c.startswith(s.outcome_prefixes)]
    skip = {"event_id", "open30_value", "mr_z"}
    factors = [c for c in discovery.factor_columns(panel, targets, s) if c not in skip]
    factors = discovery.covered_columns(panel, factors, 0.5)
    made: dict[str, DataFrame] = {}

    def keep(level: str, df: DataFrame | None, csv: bool = False) -> DataFrame | None:
        if df is None:
            return None
        path = f"{out}/{name}_{level}"
        sinks.write_parquet(df, path)
        made[level] = spark.read.parquet(path)
        if csv:
            sinks.write_csv(made[level], f"{path}_csv", single=True)
        return made[level]

    try:
        keep("hypotheses", hypotheses.run_hypotheses(panel, target, s))
        level1 = keep("single_factors", discovery.single_factors(panel, target, factors, s))
        keep("combinations", discovery.combinations_of(panel, target, level1, s))
        if deep and (fitted := models.all_factors_model(panel, target, factors, s)) is not None:
            predicted, model, inputs = fitted
            keep("model_deciles", models.decile_report(predicted, target))
            keep("model_ic", models.prediction_ic(predicted, target))
            keep("model_importance", models.permutation_importance(predicted, model, inputs, factors, s.importance_repeats))
        thresholds = keep("thresholds", discovery.optimal_thresholds(panel, target, factors, s))
        keep("regimes", discovery.regime_conditional(panel, target, factors[: s.regime_top_factors], s=s))
        if found := market_factors(factors):
            keep("lead_lag", discovery.lead_lag(panel, target, found, s=s))
        keep("sequences", discovery.sequence_patterns(panel, target, s=s))
        if found := [f for f in s.anomaly_candidates if f in factors]:
            keep("anomalies", discovery.anomaly_precursors(panel, target, found, s=s))
        keep("calendar", discovery.calendar_scan(panel, target, s))
        best = thresholds.filter("confirmed").orderBy(F.abs("is_mean").desc(), "rule").limit(s.decay_top_rules).collect()  # the strongest rules: a top-k report
        cuts = {r.rule: discovery.rule_condition(r.rule, panel.columns) for r in best}
        if cuts := {k: c for k, c in cuts.items() if c is not None}:
            keep("decay", discovery.edge_decay(rule_members(panel, target, cuts).filter("chosen").withColumnRenamed("net", "ret")))
        alphas = None
        if deep:
            covered = [f for f in factors if f in discovery.covered_columns(panel, factors, 0.8)]
            keep("clusters", regimes.hidden_clusters(panel, target, covered, s=s) if covered else None)
            siblings = [t for t in targets if t != target and not t.startswith(("go_", "rev_", "filled_", "tb_hit"))]
            alphas = keep("alphas", formulas.evolve(panel, target, factors, siblings, s))
            keep("review_pack", formulas.review_pack(alphas, panel), csv=True)
        tested = sum(df.count() for level, df in made.items() if level in SEARCHES) + (s.gp_trials_each * alphas.count() if alphas is not None else 0)
        ruled, conditions = candidates(panel, level1, alphas, s)
        if conditions:
            members = rule_members(ruled, target, conditions)
            gauntlet = keep("gauntlet", validation.gauntlet(members, max(2, tested), s))
            judged(panel, members.filter("chosen"), gauntlet, factors, keep, s, deep)
    finally:
        panel.unpersist()
    return made


#: Result tables whose rows are hypotheses: as many trials the best Sharpe ratio is deflated for.
SEARCHES = ("single_factors", "combinations", "thresholds", "regimes", "lead_lag", "sequences", "anomalies", "calendar", "decay", "clusters")


def candidates(panel: DataFrame, level1: DataFrame, alphas: DataFrame | None, s: Settings = SETTINGS) -> tuple[DataFrame, dict[str, Column]]:
    """The rules that run the gauntlet: (the panel with a flag for each formula, conditions by rule)."""
    best = level1.filter("confirmed AND fdr_pass").orderBy(F.col("spread").desc(), "factor").limit(s.gauntlet_top_single).collect()  # the strongest: a top-k report
    conditions = {f"L1:{r.factor}": level1_condition(r) for r in best}
    for i, r in enumerate(alphas.filter("confirmed").collect() if alphas is not None else []):
        panel = formulas.top_decile(panel, r.formula, r.oos_ic, f"_alpha{i}")
        conditions[f"L6:{r.formula[:60]}"] = F.col(f"_alpha{i}")
    return panel, conditions


def judged(panel: DataFrame, chosen: DataFrame, gauntlet: DataFrame, factors: list[str], keep, s: Settings = SETTINGS, deep: bool = True) -> None:
    """What becomes of the rules that passed the gauntlet. chosen: the events that each rule took."""
    good = chosen.join(gauntlet.filter(F.col("grade").isin(*TRADED)).select("rule"), "rule", "left_semi")
    cuts = keep("boundaries", validation.boundaries(good, s))
    book = good.join(cuts.filter("boundary_pass").select("rule"), "rule", "left_semi").persist()
    rules = sorted(r.rule for r in book.select("rule").distinct().collect())  # a few rules
    if rules:
        keep("overlap", portfolio.signal_overlap(book))
        keep("pnl_correlation", portfolio.pnl_correlation(book, s))
        keep("book", portfolio.combined_book(book, ["event_id"], s))
        keep("daily_pnl", portfolio.book_days(book, ["event_id"], s), csv=True)
        keep("capacity", portfolio.capacity(book, s=s))
        keep("spa", validation.spa_stepdown(book))
        if deep:
            keep("meta_labels", models.run_meta_labels(panel, book, rules, factors, s))
        states = discovery.covered_columns(panel, [c for c in s.regime_columns if c in panel.columns], 0.6)
        days = keep("market_regimes", regimes.market_regimes(panel, states, s))
        if days is not None:
            keep("edges_by_regime", discovery.edges_by_regime(book, days, s))
        keep("drift", regimes.cusum_drift(book, s, ("date", "event_id")))
        keep("breadth", regimes.james_stein(book))
    book.unpersist()


def by_grade(gauntlet: DataFrame) -> DataFrame:
    """The best grades first, the highest net mean first among equals."""
    return gauntlet.orderBy(F.array_position(F.array(*map(F.lit, GRADES)), F.col("grade")), F.col("net_mean").desc_nulls_last(), "rule")


def summary(name: str, tables: dict[str, DataFrame]) -> str:
    """A Markdown report of all result tables; the gauntlet by grade."""
    parts = [f"# {name}"]
    for level, df in tables.items():
        shown = by_grade(df) if level == "gauntlet" else df
        parts += [f"\n## {level}: {df.count()} rows\n", sinks.markdown_table(sinks.flat(shown))]
    return "\n".join(parts) + "\n"


def confirmed_rules(gauntlet: DataFrame, boundaries: DataFrame, spa: DataFrame) -> DataFrame:
    """Rules of the two best grades that also pass the boundary and the family-wise test."""
    good = gauntlet.filter(F.col("grade").isin(*TRADED))
    return good.join(boundaries.filter("boundary_pass"), "rule", "left_semi").join(spa.filter("spa_confirmed"), "rule", "left_semi")


def score_day(frame: DataFrame, conditions: dict[str, Column], expected: dict[str, float], day: str, drifting: set[str] = frozenset(), s: Settings = SETTINGS, gap_strategy: bool = True) -> DataFrame:
    """(symbol, rule, direction, expected_net, action): what each confirmed rule says of each symbol on a day; rules that drift aren't traded."""
    rows = frame.filter(F.col("date") == F.lit(day).cast("date"))
    if gap_strategy:
        rows = rows.filter(F.abs("gap_pct") >= s.gap_min_pct)
    items = [F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("rule"), F.lit(expected.get(n)).cast("double").alias("expected_net"), F.lit("DO_NOT_TRADE" if n in drifting else "TRADE").alias("action"))) for n, c in conditions.items()]
    hits = rows.select("symbol", F.signum("gap_pct").alias("direction"), F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("r"))
    return hits.select("symbol", "direction", "r.*").orderBy(F.col("expected_net").desc(), "symbol", "rule")


def run(spark: SparkSession, root: str, out: str, symbols: list[str] | None = None, s: Settings = SETTINGS, deep: bool = True) -> dict[str, dict[str, DataFrame]]:
    """Bars under `root` to reports under `out`."""
    panels = build_panels(spark, root, symbols, s)
    sinks.write_csv(panels.report, f"{out}/audit_report", single=True)
    done = {}
    for name, panel, target in (("gap", panels.gap, GAP_TARGET), ("reversion", panels.reversion, MR_TARGET)):
        sinks.write_parquet(panel, f"{out}/{name}_panel")  # searches start from a table, not from the whole plan
        done[name] = run_strategy(spark.read.parquet(f"{out}/{name}_panel"), target, name, out, s, deep)
        sinks.write_text(spark, summary(name, done[name]), f"{out}/{name}_summary")
    return done


def main(argv: list[str] | None = None) -> None:
    import argparse

    parser = argparse.ArgumentParser(description="bars to tested rules")
    parser.add_argument("root")
    parser.add_argument("out")
    parser.add_argument("--symbols", nargs="*")
    parser.add_argument("--shallow", action="store_true", help="leave out clusters, trees and evolved formulas")
    a = parser.parse_args(argv)
    run(SparkSession.builder.getOrCreate(), a.root, a.out, a.symbols, deep=not a.shallow)


if __name__ == "__main__":
    main()
