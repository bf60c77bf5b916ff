"""The engine's model laid over the driver's tables, for queries that DuckDB can check.

orders by market segment give daily bars (price: o_totalprice); each order is an event with factors from its customer and its
lines; events by type give intraday bars, one for each event. Every frame has a twin as SQL text.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import SETTINGS
from tidemark.operators.discovery import condition_members

SPLIT = "1999-12-31"
SAMPLE_SETTINGS = replace(SETTINGS, train_end=SPLIT, min_events=50, boundary_dates=("1997-12-31", "1999-12-31", "2000-12-31"), gap_go_horizons=(5, 15, 30), mr_horizons=(3, 5, 10), tb_max_min=20, mr_zscore_entry=1.5, gap_min_pct=5.0, audit_jump_pct=300.0, audit_stale_days=1)
FACTORS = ["acctbal", "qty", "disc", "n_items"]


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, date, open, high, low, close, volume): a segment's orders of a day as a bar."""
    o, c = tables(spark, sf_dir, "orders", "customer")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("c_mktsegment").alias("symbol"), F.to_date("o_orderdate").alias("date"), "o_orderkey", "o_totalprice")
    return rows.groupBy("symbol", "date").agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", "o_orderkey").alias("close"),
        F.count("*").cast("double").alias("volume"),
    )


DAYS_SQL = """
d0 AS (SELECT c_mktsegment AS symbol, CAST(o_orderdate AS DATE) AS date, o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey),
d AS (SELECT symbol, date, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close,
      CAST(count(*) AS DOUBLE) AS volume FROM d0 GROUP BY symbol, date)
"""


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, symbol, nation, date, acctbal, qty, disc, n_items, target): each order as an event."""
    o, c, n, li = tables(spark, sf_dir, "orders", "customer", "nation", "lineitem")
    lines = li.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("qty"), F.max("l_discount").alias("disc"), F.count("*").cast("double").alias("n_items"))
    out = o.join(c, o["o_custkey"] == c["c_custkey"]).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(lines, o["o_orderkey"] == lines["l_orderkey"])  # nation: a fixed list
    return out.select(
        F.col("o_orderkey").alias("event_id"), F.col("c_mktsegment").alias("symbol"), F.col("n_name").alias("nation"), F.to_date("o_orderdate").alias("date"), F.col("c_acctbal").alias("acctbal"),
        "qty", "disc", "n_items", ((F.col("o_totalprice") - 250000) / 100000).alias("target"), F.col("o_totalprice").alias("open30_value"),
    )


EVENTS_SQL = """
li AS (SELECT l_orderkey, sum(l_quantity) AS qty, max(l_discount) AS disc, CAST(count(*) AS DOUBLE) AS n_items FROM lineitem GROUP BY l_orderkey),
e AS (SELECT o_orderkey AS event_id, c_mktsegment AS symbol, n_name AS nation, CAST(o_orderdate AS DATE) AS date, c_acctbal AS acctbal, qty, disc, n_items,
      (o_totalprice - 250000) / 100000 AS target, o_totalprice AS open30_value
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN li ON o_orderkey = l_orderkey)
"""


def rule_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rule, event_id, symbol, date, open30_value, net): the events of five simple rules, net of the flat cost."""
    rules = {"rich": F.col("acctbal") > 5000, "poor": F.col("acctbal") < 0, "bulk": F.col("qty") > 120, "monday": F.weekday("date") == 0, "single": F.col("n_items") == 1}
    out = condition_members(order_events(spark, sf_dir), rules, "target", ["event_id", "symbol", "date", "open30_value"], "rule")
    return out.withColumn("net", F.col("ret") - SETTINGS.cost_pct).drop("ret")


RULES_SQL = (
    EVENTS_SQL
    + """,
m AS (SELECT rule, event_id, symbol, date, open30_value, target - 0.06 AS net FROM (
      SELECT 'rich' AS rule, * FROM e WHERE acctbal > 5000 UNION ALL SELECT 'poor', * FROM e WHERE acctbal < 0 UNION ALL SELECT 'bulk', * FROM e WHERE qty > 120
      UNION ALL SELECT 'monday', * FROM e WHERE isodow(date) = 1 UNION ALL SELECT 'single', * FROM e WHERE n_items = 1))
"""
)


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, ts, open, high, low, close, volume): each event as a bar from the value before it that day to its own."""
    (ev,) = tables(spark, sf_dir, "events")
    w = Window.partitionBy("event_type", F.to_date("ts")).orderBy("ts", "event_id")
    rows = ev.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.coalesce(F.lag("value").over(w), F.col("value")).alias("open"), F.col("value").alias("close"), "event_id")
    volume = (F.col("event_id") % 7 + 1).cast("double")
    return rows.select("symbol", "ts", "open", F.greatest("open", "close").alias("high"), F.least("open", "close").alias("low"), "close", volume.alias("volume"))


BARS_SQL = """
b0 AS (SELECT event_type AS symbol, ts, CAST(ts AS DATE) AS date, coalesce(lag(value) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id), value) AS open, value AS close, event_id FROM events),
b AS (SELECT symbol, ts, date, open, greatest(open, close) AS high, least(open, close) AS low, close, CAST(event_id % 7 + 1 AS DOUBLE) AS volume FROM b0)
"""


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """Floating columns rounded, so that the order of summation doesn't show."""
    return df.select(*(F.round(c, other.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
