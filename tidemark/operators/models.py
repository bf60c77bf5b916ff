"""Learned models over events: boosted trees on all factors, and a second opinion on fired rules."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import SETTINGS, Settings
from tidemark.functions.columns import annualised_sharpe, corr
from tidemark.operators.stats import edge_metrics, ranked


def with_missing_flags(df: DataFrame, columns: list[str], train: DataFrame) -> tuple[DataFrame, list[str]]:
    """Training medians in place of missing values, and a flag for each column that says so: trees can split on it."""
    doubles = {c: F.col(c).cast("double") for c in columns}
    fitted = Imputer(inputCols=columns, outputCols=[f"_f_{c}" for c in columns], strategy="median").fit(train.withColumns(doubles))
    out = fitted.transform(df.withColumns(doubles)).withColumns({f"_m_{c}": F.col(c).isNull().cast("double") for c in columns})
    return out, [f"_f_{c}" for c in columns] + [f"_m_{c}" for c in columns]


def all_factors_model(panel: DataFrame, target: str, columns: list[str], s: Settings = SETTINGS, seed: int = 42, trees: int = 60, least: tuple[int, int] = (500, 200)) -> tuple[DataFrame, object, list[str]] | None:
    """Level 3: (test rows with prediction, model, inputs). None where there are too few rows."""
    side = F.col("date") <= F.lit(s.train_end).cast("date")
    rows = panel.filter(F.col(target).isNotNull()).withColumn("_y", F.col(target).cast("double"))
    n = rows.agg(F.count_if(side).alias("a"), F.count_if(~side).alias("b")).first()
    if n.a < least[0] or n.b < least[1]:
        return None
    ready, inputs = with_missing_flags(rows, columns, rows.filter(side))
    ready = VectorAssembler(inputCols=inputs, outputCol="_x").transform(ready)
    model = GBTRegressor(featuresCol="_x", labelCol="_y", maxDepth=4, stepSize=0.1, maxIter=trees, seed=seed).fit(ready.filter(side))
    return model.transform(ready.filter(~side)), model, inputs


def decile_report(predicted: DataFrame, target: str) -> DataFrame:
    """(side, figures...) of the top and bottom tenth of predictions. Tenths come from two quantiles, not from a global sort."""
    low, high = predicted.agg(F.percentile("prediction", F.array(F.lit(0.1), F.lit(0.9))).alias("q")).first().q
    side = F.when(F.col("prediction") >= high, "top").when(F.col("prediction") <= low, "bottom")
    return edge_metrics(predicted.select(side.alias("side"), F.col(target).cast("double").alias("ret"), "date").filter("side IS NOT NULL"), ["side"], on=None)


def prediction_ic(predicted: DataFrame, target: str) -> DataFrame:
    """(ic, n): rank correlation of prediction and target over all rows, ranked in many tasks."""
    both = predicted.select("prediction", F.col(target).cast("double").alias("_y")).filter("prediction IS NOT NULL AND _y IS NOT NULL")
    return ranked(both, {"_a": "prediction", "_b": "_y"}).agg(corr("_a", "_b").alias("ic"), F.count("*").alias("n"))


def permutation_importance(predicted: DataFrame, model, inputs: list[str], columns: list[str], repeats: int = 5, seed: int = 42) -> DataFrame:
    """(factor, importance): how much the squared error grows when a factor's values are dealt anew among the rows."""
    rows = predicted.drop("_x", "prediction").withColumn("_id", F.monotonically_increasing_id())
    mean = lambda df: model.transform(VectorAssembler(inputCols=inputs, outputCol="_x").transform(df)).agg(F.avg((F.col("prediction") - F.col("_y")) ** 2)).first()[0]
    base, out = mean(rows), []
    for c in columns:
        grown = []
        for r in range(repeats):
            # Shuffled within hash slices, so the dealing isn't one global sort.
            slice_ = F.pmod(F.xxhash64("_id", F.lit(r)), F.lit(64))
            w = Window.partitionBy("_s")
            pairs = rows.withColumn("_s", slice_)
            here = pairs.withColumn("_k", F.row_number().over(w.orderBy("_id")))
            there = pairs.select("_s", F.row_number().over(w.orderBy(F.xxhash64("_id", F.lit(seed + r)), "_id")).alias("_k"), F.col(f"_f_{c}").alias("_a"), F.col(f"_m_{c}").alias("_b"))
            dealt = here.drop(f"_f_{c}", f"_m_{c}").join(there, ["_s", "_k"]).withColumnsRenamed({"_a": f"_f_{c}", "_b": f"_m_{c}"})
            grown.append(mean(dealt) - base)
        out.append((c, float(sum(grown) / repeats)))
    return predicted.sparkSession.createDataFrame(out, "factor string, importance double").orderBy(F.col("importance").desc(), "factor")


def uniqueness_weights(fired: DataFrame) -> DataFrame:
    """Events of the same day share one day's weight."""
    return fired.withColumn("weight", 1 / F.count("*").over(Window.partitionBy("date")))


def meta_label(fired: DataFrame, columns: list[str], s: Settings = SETTINGS, seed: int = 0, trees: int = 40) -> DataFrame | None:
    """Which events of a rule to take: a boosted classifier of net > 0, calibrated, cut at a probability, sized by a part of Kelly.

    fired: date, net and columns. One row of figures out of sample; None where there are too few events. An event that isn't
    taken counts as zero in the filtered Sharpe ratio; stakes are kelly_fraction * (2 p - 1), at least none and at most all.
    """
    side = F.col("date") <= F.lit(s.train_end).cast("date")
    rows = uniqueness_weights(fired.filter("net IS NOT NULL")).withColumn("label", (F.col("net") > 0).cast("double"))
    n = rows.agg(F.count("*").alias("n"), F.count_if(side).alias("a"), F.count_if(~side).alias("b"), F.count_distinct(F.when(side, F.col("label"))).alias("k")).first()
    if n.n < s.meta_min_events or n.a < s.meta_min_events // 2 or n.b < 50 or n.k < 2:
        return None
    ready, inputs = with_missing_flags(rows, columns, rows.filter(side))
    ready = VectorAssembler(inputCols=inputs, outputCol="_x").transform(ready)
    train = ready.filter(side)
    last = train.groupBy("date").count().select("date", (F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("date")) > 0.75 * n.a).alias("_half"))  # one row for each day
    train = train.join(F.broadcast(last), "date")
    model = GBTClassifier(featuresCol="_x", labelCol="label", weightCol="weight", maxDepth=3, maxIter=trees, subsamplingRate=0.7, seed=seed).fit(train.filter("NOT _half"))
    raw = lambda df: model.transform(df).withColumn("_p", F.get(vector_to_array("probability"), F.lit(1)))
    calibrated = IsotonicRegression(featuresCol="_p", labelCol="label", weightCol="weight", predictionCol="prob").fit(raw(train.filter("_half")))
    test = calibrated.transform(raw(ready.filter(~side)))
    top = sorted(zip(inputs, model.featureImportances.toArray(), strict=True), key=lambda x: -x[1])[:6]
    return meta_figures(test, s).withColumns({"n_train": F.lit(n.a), "top_features": F.lit(", ".join(i[3:] for i, _ in top))})


def meta_figures(test: DataFrame, s: Settings = SETTINGS, least: int = 30) -> DataFrame:
    """One row: what taking the events of at least a probability, and sizing all by it, would have made. test: net, prob."""
    taken, net = F.col("prob") >= s.meta_prob_threshold, F.col("net")
    flat = F.when(taken, net).otherwise(0.0)
    stake = F.greatest(F.lit(0.0), F.least(F.lit(1.0), s.kelly_fraction * (2 * F.col("prob") - 1)))
    out = test.agg(
        F.count("*").alias("n_oos"), F.avg(net).alias("oos_base_mean"), F.when(F.count_if(taken) >= least, F.avg(F.when(taken, net))).alias("oos_filtered_mean"), F.avg(taken.cast("double")).alias("oos_kept_frac"),
        annualised_sharpe(F.avg(net), F.stddev_pop(net)).alias("oos_base_sharpe"), annualised_sharpe(F.avg(flat), F.stddev_pop(flat)).alias("oos_filtered_sharpe"),
        F.avg(stake * net).alias("oos_kelly_mean"), F.avg(flat).alias("_flat"),
    )
    better = (F.col("oos_filtered_mean") > F.col("oos_base_mean")) & (F.col("_flat") >= 0.8 * F.col("oos_base_mean"))
    return out.withColumn("improves", F.coalesce(better, F.lit(False))).drop("_flat")


def run_meta_labels(panel: DataFrame, members: DataFrame, rules: list[str], columns: list[str], s: Settings = SETTINGS, trees: int = 40) -> DataFrame | None:
    """meta_label for each of a few rules: (rule, figures...). members: rule, event_id, net of the events that each rule took; panel: event_id, date, columns."""
    out = None
    for rule in rules:
        fired = panel.select("event_id", "date", *columns).join(members.filter(F.col("rule") == rule).select("event_id", "net"), "event_id")
        found = meta_label(fired, columns, s, trees=trees)
        if found is not None:
            found = found.withColumn("rule", F.lit(rule))
            out = found if out is None else out.unionByName(found)
    return out
