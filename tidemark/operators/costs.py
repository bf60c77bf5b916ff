"""What a round trip costs, in percent of its notional."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import SETTINGS, Settings


def trade_cost_pct(value: Column, at_open: Column | bool = False, gap_abs: Column | float = 0.0, s: Settings = SETTINGS) -> Column:
    """Statutory part, plus spread and square-root impact (doubled in the opening auction), plus gap slippage."""
    at_open = at_open if isinstance(at_open, Column) else F.lit(at_open)
    gap = gap_abs if isinstance(gap_abs, Column) else F.lit(float(gap_abs))
    share = F.least(F.lit(s.trade_value) / F.greatest(value.cast("double"), F.lit(1.0)), F.lit(1.0))
    moved = F.lit(s.spread_base_pct) + F.lit(s.impact_coef) * F.sqrt(share) * 100
    return F.lit(s.statutory_pct) + moved * F.when(at_open, s.open_auction_mult).otherwise(1.0) + F.lit(s.gap_slippage_coef) * F.abs(gap)


def with_event_costs(panel: DataFrame, strategy: str, value: str = "open30_value", gap: str = "gap_pct", s: Settings = SETTINGS) -> DataFrame:
    """panel with cost_pct. Missing values take the panel's median, or the default where there is no value at all."""
    if value in panel.columns:
        middle = panel.agg(F.percentile(F.col(value).cast("double"), 0.5)).first()[0]
        v = F.coalesce(F.col(value).cast("double"), F.lit(s.default_traded_value if middle is None else middle))
    else:
        v = F.lit(s.default_traded_value)
    slip = F.coalesce(F.abs(F.col(gap)), F.lit(0.0)) if strategy == "gap" and gap in panel.columns else F.lit(0.0)
    return panel.withColumn("cost_pct", trade_cost_pct(v, strategy == "gap", slip, s))


def cost_summary(panel: DataFrame, by: list[str] | None = None) -> DataFrame:
    c = F.col("cost_pct")
    return panel.groupBy(*(by or [])).agg(F.bround(F.avg(c), 4).alias("cost_mean"), F.bround(F.percentile(c, 0.9), 4).alias("cost_p90"), F.bround(F.max(c), 4).alias("cost_max"))
