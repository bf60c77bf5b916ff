"""Tests that a rule must stand before it is traded. Returns come net of costs.

Deterministic tests are plain aggregations over members (rule, date, net). Resampling tests run their replicates as
groups: each replicate's random stream follows from its own number, so results don't depend on how they are dealt out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import SETTINGS, Settings
from tidemark.functions.distributions import normal_cdf_udf, normal_ppf
from tidemark.session import ship_package, work_folder

EULER = 0.5772156649


def walk_forward(members: DataFrame, s: Settings = SETTINGS, order: tuple[str, ...] = ("date",)) -> DataFrame:
    """Equal chronological folds of each rule; inner ones lose `embargo_days` at either end. Most folds' means must be positive."""
    k = s.n_cv_folds
    rows = members.filter("net IS NOT NULL")
    w = Window.partitionBy("rule")
    f = rows.withColumns({"_n": F.count("*").over(w), "fold": F.ntile(k).over(w.orderBy(*order))}).filter(F.col("_n") >= 20 * k)
    fold = Window.partitionBy("rule", "fold")
    f = f.withColumns({"_a": F.date_add(F.min("date").over(fold), s.embargo_days), "_z": F.date_sub(F.max("date").over(fold), s.embargo_days)})
    core = f.filter(F.col("fold").isin(1, k) | F.col("date").between(F.col("_a"), F.col("_z")))
    means = core.groupBy("rule", "fold").agg(F.avg("net").alias("mean"), F.count("*").alias("n")).filter("n >= 10")
    out = means.groupBy("rule").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("fold", F.bround("mean", 4).alias("m")))), lambda x: x["m"]).alias("cv_fold_means"),  # as many as folds
        F.count_if(F.col("mean") > 0).alias("cv_positive"), F.count("*").alias("cv_folds"), F.avg("mean").alias("cv_mean"),
    )
    passed = (F.col("cv_positive") >= F.ceil(F.col("cv_folds") * 0.6)) & (F.col("cv_mean") > 0)
    known = rows.select("rule").distinct()
    return known.join(out, "rule", "left").withColumn("cv_pass", F.coalesce(passed, F.lit(False)))


def moments(members: DataFrame) -> DataFrame:
    """(rule, n, mean, sd, skew, kurt): population skewness and kurtosis (3 for a normal)."""
    return members.filter("net IS NOT NULL").groupBy("rule").agg(
        F.count("*").alias("n"), F.avg("net").alias("mean"), F.stddev_samp("net").alias("sd"), F.skewness("net").alias("skew"), (F.kurtosis("net") + 3).alias("kurt")
    )


def deflated_sharpe(members: DataFrame, trials: int) -> DataFrame:
    """The probability that a rule's Sharpe ratio beats the best that so many trials give by luck."""
    luck = (1 - EULER) * normal_ppf(1 - 1 / trials) + EULER * normal_ppf(1 - 1 / (trials * math.e)) if trials > 1 else 0.0
    m = moments(members)
    sr = F.when(F.col("sd") > 0, F.col("mean") / F.col("sd")).otherwise(0.0)
    m = m.withColumn("sr", sr)
    spread = F.sqrt(F.greatest(F.lit(1e-12), (1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") * F.col("sr")) / (F.col("n") - 1)))
    z = F.when(F.col("n") >= 50, (F.col("sr") - F.lit(luck) / F.sqrt(F.col("n") - 1)) / spread)
    out = m.withColumn("dsr_z", z)
    dsr = F.when(F.col("dsr_z").isNotNull(), F.bround(normal_cdf_udf(F.coalesce("dsr_z", F.lit(0.0))), 4))
    return out.withColumn("dsr", dsr).withColumn("dsr_pass", F.coalesce(F.col("dsr") > 0.95, F.lit(False))).withColumn("n_trials_deflated_for", F.lit(trials))


def cscv_splits(members: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """For each way to take half of the time blocks as in-sample: the winning rule's rank out of sample, as a logit."""
    k = s.cscv_splits
    rows = members.filter("net IS NOT NULL")
    days = rows.select("date").distinct().withColumn("block", F.ntile(k).over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1)  # one row for each day
    cells = rows.join(days, "date").groupBy("rule", "block").agg(F.avg("net").alias("m"), F.count("*").alias("n")).filter("n >= 5").select("rule", "block", "m")
    splits = members.sparkSession.range(1 << k).filter(F.bit_count("id") == k // 2).select(F.col("id").alias("split"))
    # Blocks times splits is a fixed number (8 * 70): they are listed, then joined by block.
    sides = splits.select("split", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("block")).withColumn("inside", F.expr("(shiftright(split, block) & 1) = 1"))
    perf = cells.join(F.broadcast(sides), "block").groupBy("split", "rule").agg(F.avg(F.when(F.col("inside"), F.col("m"))).alias("a"), F.avg(F.when(~F.col("inside"), F.col("m"))).alias("b"))
    w = Window.partitionBy("split")
    valid = F.col("b").isNotNull()
    ranked = perf.withColumns({
        "_win": F.row_number().over(w.orderBy(F.col("a").desc_nulls_last(), "rule")), "_valid": F.count("b").over(w),
        "_rank": F.when(valid, F.rank().over(w.orderBy(F.col("b").asc_nulls_last())) + (F.count("*").over(Window.partitionBy("split", "b")) - 1) / 2),
    })
    won = ranked.filter((F.col("_win") == 1) & F.col("a").isNotNull() & valid & (F.col("_valid") >= 2))
    share = F.col("_rank") / (F.col("_valid") + 1)
    return won.select("split", F.col("rule").alias("winner"), F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.ln(share / (1 - share)))).alias("logit"))


def cscv_pbo(members: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """(pbo, pbo_pass): how often the in-sample winner is in the lower half out of sample. A single rule passes; too sparse a table fails."""
    k = s.cscv_splits
    rows = members.filter("net IS NOT NULL")
    days = rows.select("date").distinct().withColumn("block", F.ntile(k).over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1)
    full = rows.join(days, "date").groupBy("rule", "block").agg(F.count("*").alias("n")).filter("n >= 5").agg(F.count("*").alias("full"))
    rules = members.agg(F.count_distinct("rule").alias("rules"))
    share = cscv_splits(members, s).agg(F.avg((F.col("logit") <= 0).cast("double")).alias("share"))
    out = rules.crossJoin(full).crossJoin(share)  # one row each
    sparse = 1 - F.col("full") / (F.col("rules") * k) > 0.4
    pbo = F.when((F.col("rules") >= 2) & ~sparse, F.bround("share", 3))
    return out.select(pbo.alias("pbo")).join(out.select("rules"), F.lit(True)).select("pbo", F.when(F.col("rules") < 2, True).otherwise(F.coalesce(F.col("pbo") <= s.pbo_max, F.lit(False))).alias("pbo_pass"))


def _seeded(*numbers: int) -> np.random.Generator:
    return np.random.default_rng(np.random.SeedSequence(numbers))


def _stationary(rng: np.random.Generator, n: int, block: float, size: int) -> np.ndarray:
    """Places of a stationary bootstrap sample: runs of geometric length that wrap around."""
    fresh = rng.random(size) < 1 / block
    fresh[0] = True
    starts = rng.integers(n, size=size)
    at = np.flatnonzero(fresh)
    which = np.repeat(at, np.diff(np.append(at, size)))
    return (starts[which] + np.arange(size) - which) % n


def _stationary_mean(rng: np.random.Generator, sums: np.ndarray, n: int, block: float) -> float:
    """The mean of a stationary bootstrap sample: runs of geometric length that wrap around, read off running sums of two rounds of the series."""
    runs, ends = int(n / block + 4 * math.sqrt(n / block)) + 8, np.zeros(1, np.int64)
    while ends[-1] < n:
        ends = np.append(ends, ends[-1] + np.cumsum(rng.geometric(1 / block, size=runs)))
    lengths = np.diff(np.minimum(ends[: np.searchsorted(ends, n) + 1], n))
    starts = rng.integers(n, size=len(lengths))
    rounds, rest = np.divmod(lengths, n)
    return (rounds.sum() * sums[n] + (sums[starts + rest] - sums[starts]).sum()) / n


def _drawn_sums(rng: np.random.Generator, x: np.ndarray, sizes: np.ndarray, cells: int = 1 << 21) -> np.ndarray:
    """For each size the sum of so many values of x, drawn at random without replacement.

    The lesser side is drawn. Each value is taken with a chance a little below its due; what lacks is added one by one, where draws
    of values taken already count for nothing. Either way every set of that size is as likely as any other.
    """
    n, total = len(x), x.sum()
    out = np.where(sizes >= n, total, 0.0)
    part = np.flatnonzero((sizes > 0) & (sizes < n))
    for at in np.array_split(part, max(1, -(-len(part) * n // cells))):  # a bound on memory
        if not len(at):
            continue
        least = np.minimum(sizes[at], n - sizes[at])
        chance = (np.maximum(0, least - 4 * np.sqrt(least)) * 256 // n).astype(np.uint8)
        taken = rng.integers(256, size=(len(at), n), dtype=np.uint8) < chance[:, None]
        have = np.count_nonzero(taken, axis=1)
        taken[have > least] = False  # too many, which is rare: all are drawn one by one
        have[have > least] = 0
        while (lack := least - have).any():
            taken[np.repeat(np.arange(len(at)), lack), rng.integers(n, size=lack.sum())] = True
            have = np.count_nonzero(taken, axis=1)
        got = taken @ x
        out[at] = np.where(sizes[at] > least, total - got, got)
    return out


def permutation_test(members: DataFrame, s: Settings = SETTINGS, seed: int = 0) -> DataFrame:
    """How often does a rule that selects as many events a day, on shuffled days, do as well? members: rule, date, net, chosen.

    A replicate deals the days' numbers of selected events to other days and takes so many of a day's events at random. Days' counts
    alone are dealt for a rule as a whole; the events of each day are drawn from side by side, for all replicates at once, from a
    random stream of the day's own number. The days are stored once, as both steps read them. Means that differ by rounding are equal.
    """
    spark = members.sparkSession
    ship_package(spark)
    rows = members.filter("net IS NOT NULL AND date IS NOT NULL").select("rule", "date", F.col("net").cast("double").alias("net"), F.coalesce("chosen", F.lit(False)).alias("chosen"))
    taken = F.coalesce(F.sum(F.when(F.col("chosen"), F.col("net"))), F.lit(0.0))
    days = rows.groupBy("rule", "date").agg(F.collect_list("net").alias("x"), F.count_if("chosen").alias("n"), taken.alias("taken"), F.count("*").alias("size"))
    path = work_folder(spark, "permutation")
    days.write.parquet(path)
    days = spark.read.parquet(path)
    some = days.schema["rule"].dataType.simpleString(), days.schema["date"].dataType.simpleString()

    def deal(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date", ignore_index=True)
        counts = pdf["n"].to_numpy()
        dealt = np.minimum([_seeded(seed, r).permutation(counts) for r in range(s.n_permutations)], pdf["size"].to_numpy())
        return pd.DataFrame({"rule": pdf["rule"], "date": pdf["date"], "place": pdf.index, "dealt": list(dealt.T)})

    def draw(parts):
        made: dict = {}
        for pdf in parts:
            for rule, place, x, dealt, n, taken in zip(pdf["rule"], pdf["place"], pdf["x"], pdf["dealt"], pdf["n"], pdf["taken"], strict=True):
                dealt = np.asarray(dealt, dtype=np.int64)
                x = np.sort(np.asarray(x, dtype=float))  # the same draws however rows arrive
                sums = _drawn_sums(_seeded(seed, s.n_permutations, place), x, dealt)
                for have, more in zip(made.setdefault(rule, [np.zeros(len(sums)), np.zeros(len(sums), np.int64), np.zeros(3)]), (sums, dealt, np.array([n, taken, np.abs(x).mean()])), strict=True):
                    have += more
        if made:
            yield pd.DataFrame({"rule": list(made), "sums": [m[0] for m in made.values()], "drawn": [m[1] for m in made.values()], "real": [m[2] for m in made.values()]})

    def judge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        sums, drawn, (n, taken, size) = (np.sum(pdf[c].tolist(), axis=0) for c in ("sums", "drawn", "real"))
        real = taken / n if n else np.nan
        beats = int((sums[drawn > 0] / drawn[drawn > 0] >= real - 1e-10 * size).sum())
        return pd.DataFrame({"rule": [key[0]], "beats": [beats], "n_selected": [int(n)], "real": [real]})

    counts = days.select("rule", "date", "n", "size").groupBy("rule").applyInPandas(deal, f"rule {some[0]}, date {some[1]}, place long, dealt array<long>")
    tasks = 4 * spark.sparkContext.defaultParallelism  # drawing takes time rather than bytes, by which Spark would merge tasks
    both = days.repartition(tasks, "rule", "date").join(counts.repartition(tasks, "rule", "date"), ["rule", "date"])
    drawn = both.select("rule", "place", "x", "dealt", "n", "taken").mapInPandas(draw, f"rule {some[0]}, sums array<double>, drawn array<long>, real array<double>")
    out = drawn.groupBy("rule").applyInPandas(judge, f"rule {some[0]}, beats long, n_selected long, real double")
    p, enough = (F.col("beats") + 1) / F.lit(s.n_permutations + 1), F.col("n_selected") >= 30
    return out.select("rule", "n_selected", F.when(enough, F.bround(p, 4)).alias("perm_p"), F.coalesce(enough & (p < 0.05), F.lit(False)).alias("perm_pass"), F.bround("real", 4).alias("net_mean"))


def bootstrap_ci(members: DataFrame, s: Settings = SETTINGS, seed: int = 0, order: tuple[str, ...] = ("date",)) -> DataFrame:
    """5 and 95 percent points of the mean under a stationary block bootstrap of each rule's chronological returns.

    A rule's returns travel once, to one group, where all replicates are drawn; only the two points come out.
    """
    ship_package(members.sparkSession)
    dates = {f.name for f in members.schema.fields if f.dataType.typeName() == "date"}
    known = members.filter("net IS NOT NULL").select("rule", "net", *(F.unix_date(c).alias(c) if c in dates else F.col(c) for c in order))  # numbers sort fast

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values([*order, "net"], kind="stable")["net"].to_numpy(dtype=float)
        mean = x.mean()
        sums = np.concatenate([[0.0], np.cumsum(np.tile(x - mean, 2))])
        means = [mean + _stationary_mean(_seeded(seed, r), sums, len(x), s.bootstrap_block) for r in range(s.n_bootstrap)]
        low, high = np.percentile(means, [5, 95])
        return pd.DataFrame({"rule": [key[0]], "n": [len(x)], "low": [low], "high": [high]})

    out = known.groupBy("rule").applyInPandas(run, "rule string, n long, low double, high double")
    enough = F.col("n") >= 50
    ci = F.when(enough, F.struct(F.bround("low", 4).alias("lo"), F.bround("high", 4).alias("hi")))
    return out.select("rule", "n", ci.alias("boot_ci_5_95"), F.coalesce(enough & (F.col("low") > 0), F.lit(False)).alias("boot_pass"))


def daily_matrix(members: DataFrame) -> DataFrame:
    """(date, rule, ret): each rule's daily mean on the calendar of all rules, 0 where it didn't trade."""
    day = members.filter("net IS NOT NULL").groupBy("rule", "date").agg(F.avg("net").alias("ret"))
    rules = day.select("rule").distinct()
    grid = day.select("date").distinct().join(F.broadcast(rules), F.lit(True))  # rules are a short list
    return grid.join(day, ["rule", "date"], "left").select("date", "rule", F.coalesce("ret", F.lit(0.0)).alias("ret"))


def spa_stepdown(members: DataFrame, replicates: int = 1000, block: int = 10, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Family-wise error over all rules: bootstrapped maximum statistics, stepped down from the strongest rule.

    A rule without variance has no statistic and isn't confirmed. The daily matrix (days by rules, one number for each) goes to one
    group once, where all replicates are drawn.
    """
    spark = members.sparkSession
    ship_package(spark)
    grid = daily_matrix(members)
    stats = grid.groupBy("rule").agg(F.count("*").alias("t"), (F.avg("ret") / F.nullif(F.stddev_samp("ret"), F.lit(0.0)) * F.sqrt(F.count("*").cast("double"))).alias("stat"))
    observed = {r.rule: (r.t, r.stat) for r in stats.collect()}  # one row for each rule
    names = sorted(observed)
    schema = "rule string, spa_stat double, spa_p double, spa_confirmed boolean"
    if not names or observed[names[0]][0] < 60:
        return spark.createDataFrame([(n, None, None, False) for n in names], schema)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="date", columns="rule", values="ret").sort_index()[names].to_numpy()
        m = m - m.mean(axis=0)
        out = []
        for r in range(replicates):
            x = m[_stationary(_seeded(seed, r), len(m), block, len(m))]
            sd = x.std(axis=0)
            with np.errstate(divide="ignore", invalid="ignore"):
                out.append(np.where(sd > 0, x.mean(axis=0) / sd * math.sqrt(len(m)), -np.inf).tolist())
        return pd.DataFrame({"stats": out})

    sample = grid.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, "stats array<double>")
    boot = np.array([r.stats for r in sample.collect()])  # replicates by rules
    active, rows, open_ = set(range(len(names))), [], True
    for name in sorted(names, key=lambda n: (observed[n][1] is None, -(observed[n][1] or 0), n)):
        stat = observed[name][1]
        if stat is None or not active:
            rows.append((name, stat, None, False))
            continue
        p = float(np.mean(boot[:, sorted(active)].max(axis=1) >= stat))
        open_ = open_ and p <= alpha
        rows.append((name, round(stat, 2), round(p, 4), open_))
        if open_:
            active.discard(names.index(name))
    return spark.createDataFrame(rows, schema)


def gauntlet(members: DataFrame, trials: int, s: Settings = SETTINGS) -> DataFrame:
    """All five tests side by side, with score and grade. members: rule, date, net, chosen (over all events of the panel)."""
    path = work_folder(members.sparkSession, "gauntlet")
    members.select("rule", "date", "net", "chosen").write.parquet(path)  # each test reads them
    members = members.sparkSession.read.parquet(path)
    chosen = members.filter("chosen")
    out = walk_forward(chosen, s).select("rule", "cv_fold_means", F.concat_ws("/", "cv_positive", "cv_folds").alias("cv_positive_folds"), "cv_pass")
    out = out.join(permutation_test(members, s), "rule", "left").join(bootstrap_ci(chosen, s).drop("n"), "rule", "left")
    out = out.join(deflated_sharpe(chosen, trials).select("rule", F.col("n").alias("n_events"), "dsr", "dsr_pass", "n_trials_deflated_for"), "rule", "left")
    out = out.join(F.broadcast(cscv_pbo(chosen, s)), F.lit(True))  # one row
    score = sum(F.coalesce(F.col(c), F.lit(False)).cast("int") for c in ("cv_pass", "perm_pass", "boot_pass", "dsr_pass", "pbo_pass"))
    grade = F.when(score == 5, "PLATINUM").when(score == 4, "GOLD").when(score == 3, "SILVER").otherwise("REJECTED")
    return out.withColumns({"gauntlet_score": score, "grade": grade})


def boundaries(members: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Each rule's net mean after each of several cut dates, and whether enough of them are positive."""
    rows = members.filter("net IS NOT NULL")
    after = {b: F.col("date") > F.lit(b).cast("date") for b in s.boundary_dates}
    out = rows.groupBy("rule").agg(
        *(F.avg(F.when(c, F.col("net"))).alias(f"_m_{b}") for b, c in after.items()), *(F.count_if(c).alias(f"n_after_{b}") for b, c in after.items())
    )
    mean = {b: F.when(F.col(f"n_after_{b}") >= 20, F.col(f"_m_{b}")) for b in after}
    positive = sum(F.coalesce((m > 0).cast("int"), F.lit(0)) for m in mean.values())
    out = out.withColumns({f"oos_after_{b}": F.bround(m, 4) for b, m in mean.items()} | {"_p": positive})
    out = out.withColumns({"boundaries_positive": F.concat(F.col("_p").cast("string"), F.lit(f"/{len(after)}")), "boundary_pass": F.col("_p") >= s.boundary_min_pass})
    return out.drop("_p", *(f"_m_{b}" for b in after))
