"""Searches for conditions under which an event's outcome differs.

Each search turns into members (condition, ret, date) and one aggregation over all conditions at once, in sample and
out of sample, rather than a loop over conditions.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import SETTINGS, Settings
from tidemark.functions.columns import over_zero, rolling_mean, rolling_std
from tidemark.functions.distributions import t_p_value
from tidemark.operators.stats import benjamini_hochberg, bucket_analysis, factor_score, inside, measured, net, spearman, unpivoted

#: Conditions that are evaluated in one select; more would make plans hard to compile.
BATCH = 100


def factor_columns(df: DataFrame, targets: list[str], s: Settings = SETTINGS) -> list[str]:
    """Numeric columns that aren't keys, targets or outcomes."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in {*s.panel_keys, *targets} and not f.name.startswith(s.outcome_prefixes)]


def covered_columns(df: DataFrame, columns: list[str], share: float = 0.6, kinds: int = 2) -> list[str]:
    """Columns with enough values that aren't missing and enough distinct ones; one pass over unpivoted values."""
    total = df.count()
    each = unpivoted(df, columns, []).groupBy("factor").agg(F.count("*").alias("n"), F.count_distinct("x").alias("k"))
    good = {r.factor for r in each.collect() if r.n > share * total and r.k >= kinds}  # a row for each column
    return [c for c in columns if c in good]


def condition_members(df: DataFrame, conditions: dict[str, Column], ret: str, keep: list[str] = ("date",), name: str = "condition") -> DataFrame:
    """(condition, keep..., ret): a row for each condition that an event meets; unknown counts as not met."""
    parts = []
    items = list(conditions.items())
    if not items:
        return df.select(*keep, F.col(ret).alias("ret"), F.lit(None).cast("string").alias(name)).limit(0)
    for i in range(0, len(items), BATCH):
        each = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in items[i : i + BATCH]))
        parts.append(df.select(*keep, F.col(ret).alias("ret"), F.explode(F.filter(each, lambda x: x.isNotNull())).alias(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def single_factors(panel: DataFrame, target: str, factors: list[str], s: Settings = SETTINGS, net_of_cost: bool = False, p_values: bool = True) -> DataFrame:
    """Level 1: each factor's best bucket in sample, held against the same bucket out of sample."""
    cost = F.col("cost_pct") if "cost_pct" in panel.columns else None
    ret = net(F.col(target), cost) if net_of_cost else F.col(target)
    long = unpivoted(panel.withColumn("ret", ret.cast("double")), factors, ["date", "ret"])
    cut = F.lit(s.train_end).cast("date")
    scores = factor_score(bucket_analysis(long.filter(F.col("date") <= cut), s.n_buckets, s.min_events, p_values))
    met = long.join(F.broadcast(scores.select("factor", "best_lo", "best_hi", "best_bucket")), "factor")  # a row for each factor
    members = met.filter(inside(F.col("x"), F.col("best_lo"), F.col("best_hi"), F.col("best_bucket")))
    both = measured(members.select("factor", "ret", "date"), ["factor"], s.train_end, p_values=p_values)
    out = scores.join(both.select("factor", "confirmed", "is_mean", "oos_mean", "oos_t", "oos_win_rate", "oos_n", "oos_n_eff", "reason"), "factor", "left")
    return benjamini_hochberg(out, "best_p", s.fdr_alpha, order=["factor"])


def combinations_of(panel: DataFrame, target: str, level1: DataFrame, s: Settings = SETTINGS, p_values: bool = True) -> DataFrame:
    """Level 2: the best buckets of the top factors, two and three at a time."""
    rows = level1.orderBy(F.col("spread").desc(), "factor").collect()  # a row for each factor
    good = [r for r in rows if r.fdr_pass][: s.combo_top_single]
    top = good if len(good) >= 2 else rows[: s.combo_top_single]
    one = {r.factor: inside(F.col(r.factor), F.lit(r.best_lo), F.lit(r.best_hi), F.lit(r.best_bucket)) for r in top}
    label = {r.factor: f"{r.factor} in ({r.best_lo:.4g}, {r.best_hi:.4g}]" for r in top}
    conditions = {}
    for k in range(2, s.combo_max_factors + 1):
        for names in combinations(one, k):
            met = one[names[0]]
            for n in names[1:]:
                met = met & one[n]
            conditions[" AND ".join(label[n] for n in names)] = met
    if not conditions:
        return measured(panel.select(F.lit("").alias("combo"), F.col(target).alias("ret"), "date").limit(0), ["combo"])
    members = condition_members(panel, conditions, target, name="combo")
    out = measured(members, ["combo"], s.train_end, p_values=p_values).filter(F.col("is_n") >= s.min_events)
    out = out.withColumn("n_factors", F.size(F.split("combo", " AND ")))
    return benjamini_hochberg(out, "is_p", s.fdr_alpha, order=["combo"])


def optimal_thresholds(panel: DataFrame, target: str, factors: list[str], s: Settings = SETTINGS, p_values: bool = True, least_kinds: int = 10) -> DataFrame:
    """The one cut of each factor, of 19 quantiles, that parts the means most, and its winning side out of sample."""
    long = unpivoted(panel.withColumn("ret", F.col(target).cast("double")).filter("ret IS NOT NULL"), factors, ["date", "ret"])
    train = long.filter(F.col("date") <= F.lit(s.train_end).cast("date"))
    shares = F.array(*(F.lit(i / 20) for i in range(1, 20)))
    cuts = train.groupBy("factor").agg(F.array_distinct(F.percentile("x", shares)).alias("cuts"), F.count("*").alias("n"), F.count_distinct("x").alias("kinds"))
    cuts = cuts.filter((F.col("n") >= 2 * s.min_events) & (F.col("kinds") >= least_kinds)).select("factor", "cuts")
    # Sums of each cell between two cuts first; the sides of a cut are then sums of cells.
    cell = F.size(F.filter("cuts", lambda c: c < F.col("x")))
    cells = train.join(F.broadcast(cuts), "factor").select("factor", cell.alias("cell"), "ret").groupBy("factor", "cell").agg(F.count("*").alias("n"), F.sum("ret").alias("s"))
    sides = cuts.select("factor", F.posexplode("cuts").alias("k", "cut")).join(cells, "factor").groupBy("factor", "k", "cut").agg(
        F.sum(F.when(F.col("cell") <= F.col("k"), F.col("n")).otherwise(0)).alias("nl"), F.sum(F.when(F.col("cell") <= F.col("k"), F.col("s")).otherwise(0.0)).alias("sl"),
        F.sum(F.when(F.col("cell") > F.col("k"), F.col("n")).otherwise(0)).alias("nh"), F.sum(F.when(F.col("cell") > F.col("k"), F.col("s")).otherwise(0.0)).alias("sh"),
    )
    parted = sides.filter((F.col("nl") >= s.min_events) & (F.col("nh") >= s.min_events)).withColumn("diff", F.col("sh") / F.col("nh") - F.col("sl") / F.col("nl"))
    best = parted.groupBy("factor").agg(F.max_by(F.struct("cut", "diff"), F.struct(F.round(F.abs("diff"), 9), -F.col("k"))).alias("b")).select("factor", "b.*")
    met = long.join(F.broadcast(best), "factor").filter(F.when(F.col("diff") > 0, F.col("x") > F.col("cut")).otherwise(F.col("x") <= F.col("cut")))
    out = measured(met.select("factor", "cut", F.when(F.col("diff") > 0, ">").otherwise("<=").alias("side"), "ret", "date"), ["factor", "cut", "side"], s.train_end, on=None, p_values=p_values)
    out = out.withColumn("rule", F.concat_ws(" ", "factor", "side", F.format_string("%.4g", "cut")))
    return benjamini_hochberg(out, "is_p", s.fdr_alpha, order=["factor"])


def regime_conditions(panel: DataFrame, train: bool, s: Settings = SETTINGS) -> dict[str, Column]:
    """Named market regimes among the panel's columns; quantiles are the split's own."""
    side = F.col("date") <= F.lit(s.train_end).cast("date")
    rows = panel.filter(side if train else ~side)
    found: dict[str, Column] = {}
    if "vix_pctile_1y" in panel.columns:
        found |= {"vix_pctile_1y:low_vol": F.col("vix_pctile_1y") <= 0.3, "vix_pctile_1y:high_vol": F.col("vix_pctile_1y") >= 0.7}
    if "nifty_above_50dma" in panel.columns:
        found |= {"nifty_above_50dma:uptrend": F.col("nifty_above_50dma") == 1, "nifty_above_50dma:downtrend": F.col("nifty_above_50dma") == 0}
    if "nifty_ret_5d" in panel.columns:
        low, high = rows.agg(F.percentile("nifty_ret_5d", F.array(F.lit(0.3), F.lit(0.7))).alias("q")).first().q or (None, None)
        found |= {"nifty_ret_5d:mkt_weak": F.col("nifty_ret_5d") < F.lit(low), "nifty_ret_5d:mkt_strong": F.col("nifty_ret_5d") > F.lit(high)}
    return found


def regime_conditional(panel: DataFrame, target: str, factors: list[str], regimes: tuple[dict, dict] | None = None, s: Settings = SETTINGS, p_values: bool = True) -> DataFrame:
    """The target, and each factor's better half, inside each regime. regimes: conditions for train and for test rows."""
    in_train, in_test = regimes or (regime_conditions(panel, True, s), regime_conditions(panel, False, s))
    side = F.col("date") <= F.lit(s.train_end).cast("date")
    rows = panel.withColumn("ret", F.col(target).cast("double")).filter("ret IS NOT NULL")
    members = condition_members(rows.filter(side), in_train, "ret", ["date", *factors], "regime").unionByName(condition_members(rows.filter(~side), in_test, "ret", ["date", *factors], "regime"))
    large = members.filter(side).groupBy("regime").agg(F.count("*").alias("_n")).filter(F.col("_n") >= 2 * s.min_events).select("regime")
    members = members.join(F.broadcast(large), "regime")
    base = measured(members.select("regime", "ret", "date"), ["regime"], s.train_end, on=None, p_values=p_values).withColumn("factor", F.lit("(baseline)"))
    long = unpivoted(members, factors, ["regime", "date", "ret"])
    middle = long.filter(side).groupBy("regime", "factor").agg(F.percentile("x", 0.5).alias("med"), F.count("*").alias("_n")).filter(F.col("_n") >= 2 * s.min_events).drop("_n")
    halves = long.join(F.broadcast(middle), ["regime", "factor"]).withColumn("side", F.when(F.col("x") > F.col("med"), ">").otherwise("<="))
    both = measured(halves.select("regime", "factor", "med", "side", "ret", "date"), ["regime", "factor", "med", "side"], s.train_end, on=None, p_values=p_values)
    pair = Window.partitionBy("regime", "factor")
    both = both.withColumns({"_least": F.min("is_n").over(pair), "_sides": F.count("*").over(pair), "_place": F.row_number().over(pair.orderBy(F.abs("is_mean").desc(), "side"))})
    best = both.filter((F.col("_least") >= s.min_events) & (F.col("_sides") == 2) & (F.col("_place") == 1)).drop("_least", "_sides", "_place")
    best = best.withColumn("factor", F.concat_ws(" ", "factor", "side", F.format_string("%.4g", "med"))).drop("med", "side")
    return benjamini_hochberg(base.unionByName(best), "is_p", s.fdr_alpha, order=["regime", "factor"])


def edge_decay(members: DataFrame, least_events: int = 20, least_years: int = 4) -> DataFrame:
    """Yearly means of each rule: early half against recent half, slope, share of years above zero. members: rule, ret, date."""
    years = members.filter(F.col("ret").isNotNull()).groupBy("rule", F.year("date").alias("year")).agg(F.avg("ret").alias("mean"), F.count("*").alias("n")).filter(F.col("n") >= least_events)
    w = Window.partitionBy("rule")
    y = years.withColumns({"_k": F.row_number().over(w.orderBy("year")), "_n": F.count("*").over(w)}).filter(F.col("_n") >= least_years)
    early = F.col("_k") <= F.floor(F.col("_n") / 2)
    out = y.groupBy("rule").agg(
        F.count("*").alias("years_active"), F.avg(F.when(early, F.col("mean"))).alias("early_mean"), F.avg(F.when(~early, F.col("mean"))).alias("recent_mean"),
        F.regr_slope("mean", "_k").alias("yearly_trend"), F.avg((F.col("mean") > 0).cast("double")).alias("pct_years_positive"),
    )
    e, r = F.col("early_mean"), F.col("recent_mean")
    return out.withColumn("status", F.when((r < 0.5 * e) & (e > 0), "DECAYING").when(r > 1.5 * e, "STRENGTHENING").otherwise("STABLE"))


def rule_condition(rule: str, columns: list[str]) -> Column | None:
    """A rule's text as a column: parts joined by AND, each `f <= x`, `f > x`, `f in (lo, hi]` or `f in value`. None if it can't be read."""
    met = F.lit(True)
    for part in (p.strip() for p in rule.split(" AND ")):
        words = part.split(None, 2)
        if len(words) != 3 or words[0] not in columns:
            return None
        x, op, value = F.col(words[0]), words[1], words[2]
        try:
            if op == "<=":
                met = met & (x <= float(value))
            elif op == ">":
                met = met & (x > float(value))
            elif op == "in" and value[:1] in "([" and "," in value:
                low, high = value.strip("([])").split(",")
                met = met & (x > float(low)) & (x <= float(high))
            elif op == "in":
                met = met & (x == float(value))
            else:
                return None
        except ValueError:
            return None
    return F.coalesce(met, F.lit(False))


def lead_lag(panel: DataFrame, target: str, factors: list[str], most: int = 5, s: Settings = SETTINGS, p_values: bool = True, order: tuple[str, ...] = ("date",)) -> DataFrame:
    """Rank correlation of factors, 1 to `most` rows earlier within the split, with the target."""
    train = F.col("date") <= F.lit(s.train_end).cast("date")
    w = Window.partitionBy("symbol", "_train").orderBy(*order)
    rows = panel.withColumn("_train", train)
    shifted = F.array(*(F.struct(F.lit(f).alias("factor"), F.lit(k).alias("extra_lag_days"), F.lag(F.col(f).cast("double"), k).over(w).alias("x")) for f in factors for k in range(1, most + 1)))
    long = rows.select("_train", F.col(target).cast("double").alias("y"), shifted.alias("z")).select("_train", "y", F.explode("z").alias("z")).select("_train", "y", "z.*")
    known = long.filter("_train AND x IS NOT NULL").groupBy("factor", "extra_lag_days").agg(F.count("*").alias("n"))
    ic = spearman(long, ["_train", "factor", "extra_lag_days"], "x", "y")
    by = ["factor", "extra_lag_days"]
    a, b = (ic.filter(c).select(*by, F.col("ic").alias(n)) for c, n in (("_train", "is_rank_ic"), ("NOT _train", "oos_rank_ic")))
    out = a.join(known, by).join(b, by, "left").filter((F.col("n") >= 2 * s.min_events) & F.col("is_rank_ic").isNotNull())
    i, o = F.col("is_rank_ic"), F.col("oos_rank_ic")
    t = i * F.sqrt((F.col("n") - 2) / F.greatest(F.lit(1e-9), 1 - i * i))
    out = out.withColumns({"t_stat": t, "confirmed": F.coalesce((F.signum(i) == F.signum(o)) & (F.abs(o) >= 0.5 * F.abs(i)), F.lit(False))})
    out = out.withColumn("is_p", t_p_value("t_stat", (F.col("n") - 2).cast("double")) if p_values else F.lit(None).cast("double"))
    return benjamini_hochberg(out, "is_p", s.fdr_alpha, order=by)


def sequence_patterns(panel: DataFrame, target: str, most: int = 3, s: Settings = SETTINGS, p_values: bool = True, order: tuple[str, ...] = ("date",)) -> DataFrame:
    """Outcomes after the last 1 to `most` outcomes of the symbol (W above zero, else L), oldest first."""
    w = Window.partitionBy("symbol").orderBy(*order)
    rows = panel.withColumn("_o", F.when(F.coalesce(F.col(target) > 0, F.lit(False)), "W").otherwise("L"))
    rows = rows.withColumns({f"_h{k}": F.lag("_o", k).over(w) for k in range(1, most + 1)})
    each = F.array(*(F.concat(F.lit(f"last {k} outcomes = "), *(F.col(f"_h{j}") for j in range(k, 0, -1))) for k in range(1, most + 1)))
    members = rows.select("date", F.col(target).cast("double").alias("ret"), F.explode(each).alias("pattern")).filter("pattern IS NOT NULL")
    out = measured(members, ["pattern"], s.train_end, on=None, p_values=p_values).filter(F.col("is_n") >= s.min_events)
    return benjamini_hochberg(out, "is_p", s.fdr_alpha, order=["pattern"])


def anomaly_precursors(panel: DataFrame, target: str, factors: list[str], cut: float = 2.0, s: Settings = SETTINGS, p_values: bool = True, order: tuple[str, ...] = ("date",)) -> DataFrame:
    """Outcomes 1 to 3 rows after a factor stood `cut` deviations from its trailing 60 rows, against those when it didn't."""
    w = Window.partitionBy("symbol").orderBy(*order)
    z = {f"_z_{f}": over_zero(F.col(f) - rolling_mean(F.col(f).cast("double"), w, 60, 1, 20), rolling_std(F.col(f).cast("double"), w, 60, 1, 20)) for f in factors}
    rows = panel.withColumns(z)
    each = F.array(*(F.struct(F.lit(f"{f}_lag{k}").alias("anomaly"), (F.abs(F.lag(f"_z_{f}", k).over(w)) >= cut).alias("hit")) for f in factors for k in (1, 2, 3)))
    long = rows.select("date", F.col(target).cast("double").alias("ret"), each.alias("a")).select("date", "ret", F.explode("a").alias("a")).select("date", "ret", "a.*").filter("hit IS NOT NULL")
    hits = measured(long.filter("hit"), ["anomaly"], s.train_end, on=None, p_values=p_values).filter(F.col("is_n") >= s.min_events)
    base = long.filter(~F.col("hit") & (F.col("date") <= F.lit(s.train_end).cast("date"))).groupBy("anomaly").agg(F.avg("ret").alias("base_mean"))
    out = hits.join(base, "anomaly", "left").withColumn("lift", F.col("is_mean") - F.col("base_mean"))
    return benjamini_hochberg(out, "is_p", s.fdr_alpha, order=["anomaly"])


def calendar_conditions(d: Column) -> dict[str, Column]:
    found = {f"weekday_{n}": F.weekday(d) == i for i, n in enumerate(("mon", "tue", "wed", "thu", "fri"))}
    found |= {"month_start_d1_3": F.day(d) <= 3, "month_end_d28p": F.day(d) >= 28, "expiry_week": (F.day(d) >= 22) & (F.weekday(d) == 3)}
    return found | {f"month_{m}": F.month(d) == m for m in range(1, 13)}


def calendar_scan(panel: DataFrame, target: str, s: Settings = SETTINGS, p_values: bool = True) -> DataFrame:
    members = condition_members(panel.withColumn("_r", F.col(target).cast("double")), calendar_conditions(F.col("date")), "_r")
    out = measured(members, ["condition"], s.train_end, on=None, p_values=p_values).filter(F.col("is_n") >= s.min_events)
    return benjamini_hochberg(out, "is_p", s.fdr_alpha, order=["condition"])


def edges_by_regime(members: DataFrame, regimes: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Each rule's net mean inside each regime, in and out of sample. members: rule, net, date; regimes: date, regime."""
    train = F.col("date") <= F.lit(s.train_end).cast("date")
    m = members.join(regimes.select("date", "regime"), "date").filter("net IS NOT NULL AND regime IS NOT NULL")
    a, b = F.avg(F.when(train, F.col("net"))), F.avg(F.when(~train, F.col("net")))
    out = m.groupBy("rule", "regime").agg(F.count_if(train).alias("n_train"), F.count_if(~train).alias("n_oos"), a.alias("_a"), b.alias("_b"))
    ok = (F.col("n_train") >= 50) & (F.col("n_oos") >= 20) & (F.col("_a") > 0) & (F.col("_b") > 0)
    return out.select("rule", "regime", "n_train", "n_oos", F.bround("_a", 4).alias("train_mean"), F.bround("_b", 4).alias("oos_mean"), F.coalesce(ok, F.lit(False)).alias("tradeable_in_regime"))

