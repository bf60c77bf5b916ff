"""Streaming counterparts: minute bars from a stream of ticks, and the drift alarm as a keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.config import SETTINGS, Settings


def bar_stream(ticks: DataFrame, width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """(symbol, ts, open, high, low, close, volume) from (symbol, ts, price); ticks later than `late` are dropped."""
    seen = ticks.withWatermark("ts", late)
    out = seen.groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.count("price").cast("double").alias("volume")
    )
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def drift_stream(returns: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """(rule, date, cusum, alarm) for each of a stream's rows (rule, date, net, mu, sd): the shortfall is kept for each rule."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (level,) = state.get if state.exists else (0.0,)
        for pdf in frames:
            out = []
            for r in pdf.sort_values("date").itertuples():
                level = max(0.0, level + (r.mu - r.net) - s.cusum_drift * r.sd)
                out.append((key[0], r.date, level, level > s.cusum_threshold * r.sd))
            yield pd.DataFrame(out, columns=["rule", "date", "cusum", "alarm"])
        state.update((level,))

    return returns.groupBy("rule").applyInPandasWithState(step, "rule string, date date, cusum double, alarm boolean", "level double", "append", GroupStateTimeout.NoTimeout)
