"""Synthetic minute bars with a planted edge, made on the executors from hashes of (seed, symbol, day, minute).

A gap beyond half a percent drifts on when the open's volume is high and back when it is low. The same seed gives the
same bars however the rows are dealt out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.sinks import write_parquet

# Shape of the synthetic session and of the planted edge.
MINUTES, FIRST_MINUTE = 375, 9 * 60 + 15
DRIFT_HIGH, DRIFT_LOW, GAP, BURST, BURST_BARS = 0.4, -0.3, 0.5, 4.0, 30


def _uniform(*parts):
    return (F.pmod(F.xxhash64(*parts), F.lit(1_000_003)) + 0.5) / 1_000_003


def _normal(*parts):
    """A standard normal from two hashed uniforms."""
    return F.sqrt(-2 * F.ln(_uniform(*parts, F.lit("a")))) * F.cos(2 * F.pi() * _uniform(*parts, F.lit("b")))


def business_days(spark: SparkSession, end: str, days: int) -> DataFrame:
    """(date, day): the last so many days from Monday to Friday, numbered from 0."""
    back = spark.range(days * 2 + 10).select(F.date_sub(F.lit(end).cast("date"), F.col("id").cast("int")).alias("date")).filter(F.weekday("date") < 5)
    return back.withColumn("day", F.lit(days) - F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("date").desc()))).filter("day >= 0")


def synthetic_bars(spark: SparkSession, symbols: int = 8, days: int = 1000, end: str = "2024-12-31", seed: int = 7, minutes: int = MINUTES) -> DataFrame:
    """(symbol, ts, open, high, low, close, volume)."""
    keys = spark.range(symbols).select(F.format_string("TEST%02d", F.col("id").cast("int")).alias("symbol"))
    key = [F.lit(seed), F.col("symbol"), F.col("day")]
    d = keys.join(F.broadcast(business_days(spark, end, days)), F.lit(True))  # days: a parameter
    d = d.withColumns({"gap": _normal(*key, F.lit("gap")) * 0.8, "busy": _uniform(*key, F.lit("busy")) > 0.5, "walk": _normal(*key, F.lit("walk")) * 0.6})
    d = d.withColumn("drift", F.when(F.abs("gap") > GAP, F.signum("gap") * F.when(F.col("busy"), DRIFT_HIGH).otherwise(DRIFT_LOW)).otherwise(0.0))
    w = Window.partitionBy("symbol").orderBy("day")
    move = F.col("gap") + F.col("drift") + F.col("walk")
    before = F.coalesce(F.sum(move).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    d = d.withColumn("start", 100 * F.exp((before + F.col("gap")) / 100))
    m = d.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(minutes - 1))))
    place = [*key, F.col("m")]
    # Noise that is zero at either end of the day lies on a straight drift, so that days join up.
    share = (F.col("m") + 1) / minutes
    wave = _normal(*place, F.lit("n")) * 0.05 * F.sqrt(share * (1 - share))
    early = F.least((F.col("m") + 1) / BURST_BARS, F.lit(1.0))  # the planted drift is over when the busy bars are
    last = F.col("start") * F.exp((F.col("drift") * early + F.col("walk") * share + wave) / 100)
    m = m.withColumn("close", last)
    day = Window.partitionBy("symbol", "day").orderBy("m")
    m = m.withColumn("open", F.coalesce(F.lag("close").over(day), F.col("start")))
    spread = F.abs(_normal(*place, F.lit("s"))) * 0.02 / 100
    volume = F.floor((500 + 1000 * _uniform(*place, F.lit("v"))) * F.when(F.col("busy") & (F.col("m") < BURST_BARS), BURST).otherwise(1.0)).cast("double")
    ts = F.timestamp_seconds(F.unix_date("date") * 86400 + (F.col("m") + FIRST_MINUTE) * 60).cast("timestamp_ntz")
    return m.select("symbol", ts.alias("ts"), "open", (F.greatest("open", "close") * (1 + spread)).alias("high"), (F.least("open", "close") * (1 - spread)).alias("low"), "close", volume.alias("volume"))


def synthetic_series(spark: SparkSession, name: str, days: int = 1000, end: str = "2024-12-31", seed: int = 7, level: float = 20000.0) -> DataFrame:
    """(date, close): a market-wide random walk."""
    d = business_days(spark, end, days)
    w = Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return d.select("date", (F.lit(level) * F.exp(F.sum(_normal(F.lit(seed), F.lit(name), F.col("day"))).over(w) / 100)).alias("close"))


def write_sample(spark: SparkSession, root: str, symbols: int = 8, days: int = 1000, seed: int = 7) -> None:
    """Minute bars, nifty and india_vix under a root, laid out as the readers expect."""
    bars = synthetic_bars(spark, symbols, days, seed=seed).persist()
    for i in range(symbols):
        name = f"TEST{i:02d}"
        write_parquet(bars.filter(F.col("symbol") == name).drop("symbol").withColumnRenamed("ts", "timestamp").coalesce(1), f"{root}/minute_bars/{name}.parquet")
    bars.unpersist()
    write_parquet(synthetic_series(spark, "nifty", days, seed=seed), f"{root}/nifty.parquet")
    write_parquet(synthetic_series(spark, "india_vix", days, seed=seed, level=15.0), f"{root}/india_vix.parquet")
