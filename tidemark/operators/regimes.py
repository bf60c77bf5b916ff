"""Drift, breadth and hidden regimes."""

from __future__ import annotations

from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import SETTINGS, Settings
from tidemark.functions.columns import over_zero
from tidemark.operators.stats import measured


def cusum_path(members: DataFrame, s: Settings = SETTINGS, order: tuple[str, ...] = ("date",)) -> DataFrame:
    """(rule, date, ..., cusum, sd): the one-sided cumulative shortfall after the training period.

    c[t] = max(0, c[t-1] + mean - x - slack) equals the running sum less its running minimum (or zero), so two
    windows replace the recursion.
    """
    train = F.col("date") <= F.lit(s.train_end).cast("date")
    rows = members.filter("net IS NOT NULL")
    base = rows.filter(train).groupBy("rule").agg(F.count("*").alias("_n"), F.avg("net").alias("mu"), F.stddev_samp("net").alias("sd")).filter("_n >= 50 AND sd > 0")
    w = Window.partitionBy("rule").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    later = rows.filter(~train).join(F.broadcast(base.drop("_n")), "rule")
    later = later.withColumn("_s", F.sum(F.col("mu") - F.col("net") - s.cusum_drift * F.col("sd")).over(w))
    return later.withColumn("cusum", F.col("_s") - F.least(F.lit(0.0), F.min("_s").over(w))).drop("_s")


def cusum_drift(members: DataFrame, s: Settings = SETTINGS, order: tuple[str, ...] = ("date",)) -> DataFrame:
    """(rule, train_mean, cusum_peak_sigma, drift_alarm, alarm_date)."""
    path = cusum_path(members, s, order)
    alarm = F.min(F.when(F.col("cusum") > s.cusum_threshold * F.col("sd"), F.col("date")))
    out = path.groupBy("rule").agg(F.bround(F.first("mu"), 4).alias("train_mean"), F.bround(F.max(F.col("cusum") / F.col("sd")), 2).alias("cusum_peak_sigma"), alarm.alias("alarm_date"))
    return out.withColumn("drift_alarm", F.col("alarm_date").isNotNull())


def shrunk_by_symbol(members: DataFrame, least: int = 10) -> DataFrame:
    """(rule, symbol, mean, n, shrunk): each symbol's mean drawn to the rule's, the more the fewer and noisier its events."""
    rows = members.filter("net IS NOT NULL")
    pooled = rows.groupBy("rule").agg(F.avg("net").alias("grand"), F.var_samp("net").alias("var"))
    each = rows.groupBy("rule", "symbol").agg(F.avg("net").alias("mean"), F.count("*").alias("n")).filter(F.col("n") >= least).join(F.broadcast(pooled), "rule")  # a row for each rule
    off, noise = F.col("mean") - F.col("grand"), F.col("var") / F.col("n")
    return each.withColumn("shrunk", F.col("grand") + (1 - F.coalesce(over_zero(noise, off * off + noise), F.lit(0.0))) * off)


def james_stein(members: DataFrame, least_symbols: int = 5) -> DataFrame:
    """(rule, n_symbols, pooled_mean, shrunk_pos_frac, concentration_hhi, broad_edge)."""
    gain = F.greatest(F.col("mean") * F.col("n"), F.lit(0.0))
    out = shrunk_by_symbol(members).groupBy("rule").agg(
        F.count("*").alias("n_symbols"), F.first("grand").alias("_g"), F.avg((F.col("shrunk") > 0).cast("double")).alias("_p"), F.sum(gain * gain).alias("_q"), F.sum(gain).alias("_t")
    ).filter(F.col("n_symbols") >= least_symbols)
    hhi = F.when(F.col("_t") > 0, F.col("_q") / (F.col("_t") * F.col("_t")))
    return out.select(
        "rule", "n_symbols", F.bround("_g", 4).alias("pooled_mean"), F.bround("_p", 3).alias("shrunk_pos_frac"), F.bround(hhi, 3).alias("concentration_hhi"),
        ((F.col("_p") >= 0.6) & (hhi.isNull() | (hhi <= 0.15))).alias("broad_edge"),
    )


def _scaled(df: DataFrame, columns: list[str], train: DataFrame) -> tuple[DataFrame, object]:
    gather = VectorAssembler(inputCols=columns, outputCol="_raw", handleInvalid="skip")
    scale = StandardScaler(inputCol="_raw", outputCol="_z", withMean=True, withStd=True).fit(gather.transform(train))
    return scale.transform(gather.transform(df)), scale


def market_regimes(panel: DataFrame, columns: list[str], s: Settings = SETTINGS, seed: int = 42) -> DataFrame | None:
    """(date, regime, confidence): a Gaussian mixture over the days' medians, fitted on training days only.

    None where fewer than three columns, 200 days or 100 training days are there.
    """
    days = panel.groupBy("date").agg(*(F.percentile(F.col(c).cast("double"), 0.5).alias(c) for c in columns)).dropna(subset=columns)
    train = days.filter(F.col("date") <= F.lit(s.train_end).cast("date"))
    if len(columns) < 3 or days.count() < 200 or train.count() < 100:
        return None
    z, _ = _scaled(days, columns, train)
    model = GaussianMixture(k=s.n_regimes, featuresCol="_z", predictionCol="regime", probabilityCol="_p", seed=seed).fit(z.filter(F.col("date") <= F.lit(s.train_end).cast("date")))
    return model.transform(z).select("date", "regime", F.array_max(vector_to_array("_p")).alias("confidence"))


def hidden_clusters(panel: DataFrame, target: str, columns: list[str], k: int = 4, s: Settings = SETTINGS, seed: int = 42, least_rows: int = 1000) -> DataFrame | None:
    """(cluster, profile, in and out of sample figures): k-means over events; the profile names the three columns farthest from the mean."""
    side = F.col("date") <= F.lit(s.train_end).cast("date")
    rows = panel.dropna(subset=[*columns, target])
    train = rows.filter(side)
    if train.count() < least_rows:
        return None
    z, _ = _scaled(rows, columns, train)
    model = KMeans(k=k, featuresCol="_z", predictionCol="cluster", seed=seed, initSteps=5).fit(z.filter(side))
    profile = {}
    for i, centre in enumerate(model.clusterCenters()):
        far = sorted(zip(columns, centre, strict=True), key=lambda x: (-abs(x[1]), x[0]))[:3]
        profile[i] = ", ".join(f"{n}{'+' if v > 0 else '-'}" for n, v in far)
    found = model.transform(z).select("cluster", F.col(target).cast("double").alias("ret"), "date")
    named = panel.sparkSession.createDataFrame(list(profile.items()), "cluster int, profile string")
    return measured(found, ["cluster"], s.train_end, on=None).join(F.broadcast(named), "cluster")  # k rows
