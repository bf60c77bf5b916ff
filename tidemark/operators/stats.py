"""Measures of a rule's returns and what decides about them.

Members are rows (keys..., ret, date): an event may belong to many rules, so many rules are measured in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import SETTINGS
from tidemark.functions.columns import annualised_sharpe, corr, over_zero
from tidemark.functions.distributions import t_p_value


def split_by_date(df: DataFrame, end: str = SETTINGS.train_end, on: str = "date") -> tuple[DataFrame, DataFrame]:
    cut = F.lit(end).cast("date")
    return df.filter(F.col(on) <= cut), df.filter(F.col(on) > cut)


def effective_n(members: DataFrame, by: list[str], ret: str = "ret", on: str = "date") -> DataFrame:
    """(keys..., n_eff): the sample size that events of the same day are worth together (Kish).

    Days are summed first; their sums of values and squares hold all that the between-day share of variance needs.
    """
    x = F.col(ret)
    days = members.filter(x.isNotNull()).groupBy(*by, F.to_date(on).alias("_d")).agg(F.count("*").alias("_n"), F.sum(x).alias("_s"), F.sum(x * x).alias("_q"))
    sums = days.groupBy(*by).agg(
        F.sum("_n").cast("double").alias("n"), F.count("*").cast("double").alias("days"), F.sum("_s").alias("s"), F.sum("_q").alias("q"), F.sum(F.col("_s") * F.col("_s") / F.col("_n")).alias("b")
    )
    n, days_, bar = F.col("n"), F.col("days"), F.col("n") / F.col("days")
    centre = F.col("s") * F.col("s") / n
    total, between = F.col("q") - centre, F.col("b") - centre
    icc = F.greatest(F.lit(0.0), F.least(F.lit(0.99), over_zero(over_zero(between, total) - 1 / bar, 1 - 1 / bar)))
    worth = F.greatest(F.least(n / (1 + (bar - 1) * icc), n), days_)
    return sums.select(*by, F.when((n < 30) | (bar <= 1.5) | (total <= 0), n).otherwise(worth).alias("n_eff"))


def edge_metrics(members: DataFrame, by: list[str], ret: str = "ret", on: str | None = "date", p_values: bool = True) -> DataFrame:
    """n, n_eff, mean_ret, median_ret, win_rate, t_stat, p_value, sharpe_like, profit_factor for each key; keys without returns have no row."""
    x = F.col(ret)
    known = members.filter(x.isNotNull())
    basic = known.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(x).alias("mean_ret"), F.percentile(x, 0.5).alias("median_ret"), F.avg((x > 0).cast("double")).alias("win_rate"),
        F.stddev_samp(x).alias("_sd"), F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0)).alias("_up"), F.sum(F.when(x < 0, x)).alias("_down"),
    )
    worth = effective_n(known, by, ret, on) if on else basic.select(*by, F.col("n").cast("double").alias("n_eff"))
    out = basic.join(worth, by) if by else basic.crossJoin(worth)
    sd = F.when(F.col("_sd") > 0, F.col("_sd"))
    t = F.when(F.col("n_eff") > 1, F.col("mean_ret") / (sd / F.sqrt("n_eff")))
    out = out.withColumn("t_stat", t)
    p = t_p_value("t_stat", F.greatest(F.floor("n_eff") - 1, F.lit(1)).cast("double")) if p_values else F.lit(None).cast("double")
    return out.select(
        *by, "n", F.round("n_eff", 1).alias("n_eff"), "mean_ret", "median_ret", "win_rate", "t_stat", p.alias("p_value"),
        annualised_sharpe(F.col("mean_ret"), F.col("_sd")).alias("sharpe_like"),
        F.when(F.col("_down").isNull(), F.lit(float("inf"))).otherwise(F.col("_up") / -F.col("_down")).alias("profit_factor"),
    )


def unpivoted(df: DataFrame, factors: list[str], keep: list[str]) -> DataFrame:
    """(keep..., factor, x): one row for each factor, without missing ones."""
    each = F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f).cast("double").alias("x")) for f in factors))
    return df.select(*keep, F.explode(each).alias("_f")).select(*keep, "_f.factor", "_f.x").filter(F.col("x").isNotNull())


def bucket_members(long: DataFrame, buckets: int = SETTINGS.n_buckets, tails: bool = True) -> DataFrame:
    """Rows of (factor, x, ...) with their bucket: lo, hi (exact edges, right-closed, the lowest included), bucket, core.

    Factors of two values or fewer have one bucket for each value; equal quantiles collapse. Where a factor has more
    than 20 values, its outer 5 and 1 percent come once more as tails. Edges are joined by factor: a few rows.
    """
    cuts = [i / buckets for i in range(buckets + 1)]
    edges = long.groupBy("factor").agg(
        F.count_distinct("x").alias("kinds"), F.array_distinct(F.percentile("x", F.array(*map(F.lit, cuts)))).alias("edges"),
        F.percentile("x", F.array(*map(F.lit, (0.95, 0.99, 0.05, 0.01)))).alias("ends"), F.count("*").alias("total"),
    )
    met = long.join(F.broadcast(edges), "factor")
    few = F.col("kinds") <= 2
    k = F.greatest(F.lit(1), F.size(F.filter("edges", lambda e: e < F.col("x"))))
    core = met.select(
        "*", F.when(few, F.col("x")).otherwise(F.get("edges", k - 1)).alias("lo"), F.when(few, F.col("x")).otherwise(F.get("edges", k)).alias("hi"),
        F.when(few, F.col("x").cast("string")).otherwise(F.concat(F.lit("q"), k.cast("string"))).alias("bucket"), F.lit(True).alias("core"),
    ).filter(few | (F.size("edges") > 1))
    if not tails:
        return core.drop("kinds", "edges", "ends", "total")
    e, inf = (lambda i: F.get("ends", F.lit(i))), F.lit(float("inf"))
    each = F.array(
        F.struct(F.lit("tail_top5").alias("bucket"), e(0).alias("lo"), inf.alias("hi"), (F.col("x") >= e(0)).alias("inside")),
        F.struct(F.lit("tail_top1").alias("bucket"), e(1).alias("lo"), inf.alias("hi"), (F.col("x") >= e(1)).alias("inside")),
        F.struct(F.lit("tail_bot5").alias("bucket"), (-inf).alias("lo"), e(2).alias("hi"), (F.col("x") <= e(2)).alias("inside")),
        F.struct(F.lit("tail_bot1").alias("bucket"), (-inf).alias("lo"), e(3).alias("hi"), (F.col("x") <= e(3)).alias("inside")),
    )
    far = met.filter("kinds > 20").withColumn("_t", F.explode(F.filter(each, lambda s: s["inside"]))).select(*met.columns, "_t.lo", "_t.hi", "_t.bucket", F.lit(False).alias("core"))
    return core.unionByName(far).drop("kinds", "edges", "ends", "total")


def bucket_analysis(long: DataFrame, buckets: int = SETTINGS.n_buckets, least: int = SETTINGS.min_events, p_values: bool = True, tails: bool = True) -> DataFrame:
    """Metrics of every factor's buckets in one aggregation; factors with too few rows or too small buckets are left out.

    long: (factor, x, ret, date). monotonicity: rank correlation of bucket order and mean over three or more core buckets.
    """
    members = bucket_members(long.filter(F.col("ret").isNotNull()), buckets, tails)
    found = edge_metrics(members, ["factor", "bucket", "core", "lo", "hi"], p_values=p_values).filter(F.col("core") | (F.col("n") >= 30))
    whole = Window.partitionBy("factor")
    inner = F.col("core")
    total, smallest = F.sum(F.when(inner, F.col("n"))).over(whole), F.min(F.when(inner, F.col("n"))).over(whole)
    kept = found.withColumns({"_total": total, "_least": smallest}).filter((F.col("_total") >= 2 * least) & (F.col("_least") >= least // buckets))
    side = Window.partitionBy("factor", "core")
    ranks = kept.withColumns({"_a": F.rank().over(side.orderBy("lo")).cast("double"), "_b": F.rank().over(side.orderBy("mean_ret")) + (F.count("*").over(side.orderBy("mean_ret").rangeBetween(0, 0)) - 1) / 2})
    rho = ranks.filter(inner).groupBy("factor").agg(F.when(F.count("*") >= 3, corr("_a", "_b")).alias("monotonicity"))
    return ranks.drop("_total", "_least", "_a", "_b").join(rho, "factor", "left")


def factor_score(analysis: DataFrame) -> DataFrame:
    """For each factor: the bucket with the highest mean (ties: the lower edge), its figures and the spread to the lowest."""
    row = F.struct("bucket", "core", "lo", "hi", "mean_ret", "win_rate", "n", "p_value")
    best = analysis.groupBy("factor").agg(
        F.max_by(row, F.struct("mean_ret", -F.col("lo"), "core")).alias("b"), F.min("mean_ret").alias("_worst"), F.first("monotonicity").alias("monotonicity")
    )
    return best.select(
        "factor", (F.col("b.mean_ret") - F.col("_worst")).alias("spread"), F.col("b.bucket").alias("best_bucket"), F.col("b.core").alias("best_core"), F.col("b.lo").alias("best_lo"),
        F.col("b.hi").alias("best_hi"), F.col("b.mean_ret").alias("best_mean"), F.col("b.win_rate").alias("best_win_rate"), F.col("b.n").alias("best_n"),
        F.col("b.p_value").alias("best_p"), "monotonicity",
    )


def inside(x: Column, lo: Column, hi: Column, bucket: Column, first: Column | None = None) -> Column:
    """Membership of a bucket given by exact edges; tails and single values too."""
    tail_top, tail_bot = bucket.startswith("tail_top"), bucket.startswith("tail_bot")
    return F.when(tail_top, x >= lo).when(tail_bot, x <= hi).when(lo == hi, x == lo).otherwise((x > lo) & (x <= hi))


def benjamini_hochberg(df: DataFrame, p: str, alpha: float = SETTINGS.fdr_alpha, by: list[str] | None = None, name: str = "fdr_pass", order: list[str] | None = None) -> DataFrame:
    """df with a flag of the hypotheses that survive: those up to the largest k whose k-th smallest p is at most alpha * k / m.

    Missing p values don't survive and aren't counted. Each family is one row per hypothesis, a small result table.
    """
    by = by or []
    known = F.col(p).isNotNull()
    family = Window.partitionBy(*by, known)
    place = F.row_number().over(family.orderBy(p, *(order or [])))
    m = F.count("*").over(family)
    out = df.withColumns({"_k": place, "_m": m})
    last = F.max(F.when(known & (F.col(p) <= alpha * F.col("_k") / F.col("_m")), F.col("_k"))).over(family)
    return out.withColumn("_last", last).withColumn(name, known & F.coalesce(F.col("_k") <= F.col("_last"), F.lit(False))).drop("_k", "_m", "_last")


def oos_confirmed(is_mean: Column, oos_mean: Column, oos_t: Column, oos_n: Column) -> Column:
    """30 events, the same sign, half the size, 0.03 at least, and a t of 1.5."""
    ok = (oos_n >= 30) & (F.signum(is_mean) == F.signum(oos_mean)) & (F.abs(oos_mean) >= 0.5 * F.abs(is_mean)) & (F.abs(oos_mean) >= 0.03) & (F.abs(oos_t) >= 1.5)
    return F.coalesce(ok, F.lit(False))


def measured(members: DataFrame, by: list[str], end: str = SETTINGS.train_end, on: str | None = "date", p_values: bool = True) -> DataFrame:
    """In-sample and out-of-sample figures of each key side by side, with the verdict. members: (keys..., ret, date)."""
    train = F.col("date") <= F.lit(end).cast("date")
    both = edge_metrics(members.withColumn("_train", train), [*by, "_train"], on=on, p_values=p_values)
    a = both.filter("_train").select(*by, F.col("n").alias("is_n"), F.col("mean_ret").alias("is_mean"), F.col("win_rate").alias("is_win"), F.col("p_value").alias("is_p"))
    b = both.filter("NOT _train").select(
        *by, F.col("n").alias("oos_n"), F.col("n_eff").alias("oos_n_eff"), F.col("mean_ret").alias("oos_mean"), F.col("win_rate").alias("oos_win_rate"), F.col("t_stat").alias("oos_t")
    )
    out = a.join(b, by, "left")
    reason = F.when(F.coalesce(F.col("oos_n"), F.lit(0)) < 30, "too few OOS events")
    return out.withColumns({"confirmed": oos_confirmed(F.col("is_mean"), F.col("oos_mean"), F.col("oos_t"), F.coalesce(F.col("oos_n"), F.lit(0))), "reason": reason})


def net(gross: Column, cost: Column | None = None) -> Column:
    """A return less its event's cost, or less the flat one."""
    flat = F.lit(SETTINGS.cost_pct)
    return gross - (flat if cost is None else F.coalesce(cost, flat))


#: Cells that a column's values are cut into to be ranked in many tasks.
RANK_CELLS = 64


def _cuts_below(cuts: list[float], x: Column) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < x))


def ranked(df: DataFrame, columns: dict[str, str], share: bool = False) -> DataFrame:
    """df with the rank (or, as a share of the values, the percentile rank) of columns among all rows: {new name: column}; ties averaged.

    Values are cut into cells at rough quantiles; a cell's rows are ranked in a task of their own, and the number of values in
    the cells below is added, so ranks are exact wherever the cuts fall. Cuts and counts (RANK_CELLS numbers for a column) pass through the driver.
    """
    if not columns:
        return df
    shares = F.array(*(F.lit(i / RANK_CELLS) for i in range(1, RANK_CELLS)))
    value = {n: F.col(c).cast("double") for n, c in columns.items()}
    cuts = df.agg(*(F.percentile_approx(value[n], shares, F.lit(1000)).alias(n) for n in columns)).first()
    # Missing values are dealt over cells of their own, so they meet in no single task.
    lost = -1 - F.pmod(F.monotonically_increasing_id(), F.lit(RANK_CELLS)).cast("int")
    at = {n: _cuts_below(cuts[n] or [0.0], value[n]) for n in columns}
    each = F.array(*(F.struct(F.lit(n).alias("name"), F.when(value[n].isNotNull(), at[n]).alias("cell")) for n in columns))
    counts = df.select(F.explode(each).alias("e")).filter("e.cell IS NOT NULL").groupBy("e.name", "e.cell").count().collect()
    out = df.withColumns({f"_cell_{n}": F.when(value[n].isNotNull(), at[n]).otherwise(lost) for n in columns})
    found = {}
    for n in columns:
        size = [0] * (RANK_CELLS + 1)
        for r in counts:
            if r.name == n:
                size[r.cell] = r["count"]
        below = F.get(F.array(*(F.lit(sum(size[:i])) for i in range(len(size)))), F.col(f"_cell_{n}"))
        inside = Window.partitionBy(f"_cell_{n}")
        place = below + F.rank().over(inside.orderBy(value[n])) + (F.count("*").over(inside.partitionBy(f"_cell_{n}", value[n])) - 1) / 2
        found[n] = F.when(value[n].isNotNull(), place / F.lit(sum(size)) if share else place)
    return out.withColumns(found).drop(*(f"_cell_{n}" for n in columns))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(keys..., ic, n): rank correlation over rows that have both values, ties averaged; keys partition the ranking."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    group = Window.partitionBy(*by)

    def rank(c):
        return F.rank().over(group.orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2

    return both.select(*by, rank(x).alias("_a"), rank(y).alias("_b")).groupBy(*by).agg(corr("_a", "_b").alias("ic"), F.count("*").alias("n"))
