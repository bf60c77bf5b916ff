"""Sources: minute bars, daily series and keyed side tables from Parquet, results from CSV.

All symbols are read in one scan; the symbol is a file's name. What isn't there is None, and plans leave out
what depends on it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import clean

# Names under which a time column is looked for, in order of preference.
BAR_TIME_NAMES = ("timestamp", "datetime", "date", "time")
SERIES_TIME_NAMES = ("timestamp", "datetime", "date")
#: A row's place in its table's files: what "first" and "last" of equal keys mean.
PLACE = "_place"
# Keys of daily series and of keyed tables.
DAILY_SERIES = (
    "nifty", "sp500", "india_vix", "crude", "usdinr", "gift_nifty", "us_vix", "us_10y",
    "dollar_index", "gold", "copper", "nikkei", "hang_seng", "rbi_repo",
)
KEYED_TABLES = (
    "corporate_actions", "earnings_dates", "news", "correlations", "fii_dii", "sector_map", "delivery", "fno_ban", "participant_oi",
    "sector_rotation", "short_selling", "bulk_deals", "cpi_wpi_iip", "nse_holidays", "constituent_changes", "promoter_pledges",
    "nifty_sector_indices", "fno_universe",
)


def find_root(spark: SparkSession, candidates: list[str]) -> str | None:
    """The first of the folders that is there, on whatever file system it names."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in candidates:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            return path
    return None


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table with lower-case names, NaN as NULL; None if there is none."""
    try:
        df = spark.read.option("mergeSchema", "false").parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return clean(df.toDF(*(c.lower() for c in df.columns)))


def _time_column(df: DataFrame, names: tuple[str, ...]) -> str:
    for name in names:
        if name in df.columns:
            return name
    raise ValueError(f"no time column among {df.columns}")


def _symbol(kind: str, path: str = "_metadata.file_path"):
    """The symbol in a path: a file, or a folder of part files, named for it under the kind's folder."""
    return F.regexp_extract(F.col(path), rf"/{kind}/([^/]+?)(?:\.parquet)?(?:/[^/]*)?$", 1)


def discover_symbols(spark: SparkSession, root: str, configured: list[str] | None = None) -> DataFrame:
    """(symbol): those configured, or else one for each file of minute bars."""
    if configured:
        return spark.createDataFrame([(s,) for s in configured], "symbol string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(f"{root}/minute_bars")
    return files.select(_symbol("minute_bars", "path").alias("symbol")).distinct()


def minute_bars(spark: SparkSession, root: str, symbols: list[str] | None = None) -> DataFrame | None:
    """(symbol, ts, open, high, low, close, volume) of all symbols; a filter on symbols skips other files."""
    path = f"{root}/minute_bars" if symbols is None else [f"{root}/minute_bars/{s}.parquet" for s in symbols]
    try:
        reader = spark.read.option("recursiveFileLookup", "true")
        df = reader.parquet(path) if isinstance(path, str) else reader.parquet(*path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    lower = {c.lower(): c for c in df.columns}
    when = next((lower[n] for n in BAR_TIME_NAMES if n in lower), None)
    if when is None:
        raise ValueError(f"no time column among {df.columns}")
    values = [F.expr(f"try_cast(`{lower[c]}` AS double)").alias(c) for c in ("open", "high", "low", "close", "volume")]
    return clean(df.select(_symbol("minute_bars").alias("symbol"), F.col(when).cast("timestamp_ntz").alias("ts"), *values))


def daily_series(spark: SparkSession, root: str, key: str, value: str | None = None) -> DataFrame | None:
    """(ts, value): the value column is the one named, or close, or the last numeric one; of equal times the last row counts."""
    df = read_if_there(spark, f"{root}/{key}.parquet")
    if df is None:
        return None
    when = _time_column(df, SERIES_TIME_NAMES)
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != when]
    chosen = value if value in df.columns else "close" if "close" in df.columns else numeric[-1] if numeric else None
    if chosen is None:
        return None
    number = F.expr(f"try_cast(`{chosen}` AS double)")
    rows = df.select(F.col(when).cast("timestamp_ntz").alias("ts"), number.alias("value"), F.monotonically_increasing_id().alias("place"))
    return rows.groupBy("ts").agg(F.max_by(F.struct("value"), "place").alias("v")).select("ts", F.col("v.value").alias("value"))


def keyed_table(spark: SparkSession, root: str, key: str) -> DataFrame | None:
    """A side table with its date as DATE and the place of each row in its files, by which of equal keys the first counts."""
    df = read_if_there(spark, f"{root}/{key}.parquet")
    if df is None:
        return None
    df = df.withColumn(PLACE, F.monotonically_increasing_id())
    return df.withColumn("date", F.to_date("date")) if "date" in df.columns else df


def per_symbol_table(spark: SparkSession, root: str, kind: str) -> DataFrame | None:
    """options or futures of all symbols, one file each: symbol, date and the file's columns."""
    try:
        df = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/{kind}")
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    named = df.withColumn("symbol", _symbol(kind))
    named = named.toDF(*(c.lower() for c in named.columns))
    when = _time_column(named, SERIES_TIME_NAMES)
    return clean(named.withColumn("date", F.to_date(when)))


def sector_map(spark: SparkSession, root: str) -> DataFrame | None:
    df = read_if_there(spark, f"{root}/sector_map.parquet")
    return None if df is None else df.withColumn(PLACE, F.monotonically_increasing_id()).groupBy("symbol").agg(F.min_by("sector", PLACE).alias("sector"))


def universe(spark: SparkSession, root: str) -> DataFrame | None:
    """(symbol, from_date, to_date): to_date NULL means still in."""
    df = read_if_there(spark, f"{root}/fno_universe.parquet")
    return None if df is None else df.select("symbol", F.to_date("from_date").alias("from_date"), F.to_date("to_date").alias("to_date"))


def result_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A result table written as CSV."""
    try:
        reader = spark.read.option("header", "true")
        return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", "true").csv(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


class Registry:
    """Which side tables are there under a root; each is planned once."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._held = spark, root, {}

    def get(self, key: str, value: str | None = None) -> DataFrame | None:
        if (key, value) not in self._held:
            if key in ("options", "futures"):
                found = per_symbol_table(self.spark, self.root, key)
            elif key == "sector_map":
                found = sector_map(self.spark, self.root)
            elif key in DAILY_SERIES:
                found = daily_series(self.spark, self.root, key, value)
            else:
                found = keyed_table(self.spark, self.root, key)
            self._held[key, value] = found
        return self._held[key, value]


def last_of(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """One row for each key: the last by an explicit order."""
    w = Window.partitionBy(*by).orderBy(F.col(order).desc())
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
