"""Sinks: CSV and Parquet tables, and Markdown or text reports of small result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a result table that a report shows; reports are top-k lists.
REPORT_ROWS = 50


def flat(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON, for formats that hold plain values only."""
    return df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes))


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    out = flat(df)
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", "true").csv(path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def markdown_table(df: DataFrame, rows: int = REPORT_ROWS) -> str:
    """The first rows as a Markdown table."""
    names = df.columns
    cell = lambda x: "" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x).replace("|", "\\|")
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join(lines + ["| " + " | ".join(cell(r[n]) for n in names) + " |" for r in df.limit(rows).collect()])


def write_text(df_spark, text: str, path: str) -> None:
    """A report as one text file, through Spark's own writer so that any file system serves."""
    df_spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
