"""Hypotheses registered before the data are seen: predicates over factors, each with a direction."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import SETTINGS, Settings
from tidemark.operators.stats import edge_metrics


@dataclass(frozen=True)
class Hypothesis:
    """needs: columns without which it can't be tested; direction -1 turns the target round, 0 takes the gap's sign."""

    name: str
    why: str
    needs: tuple[str, ...]
    direction: int
    met: Callable[[set[str]], Column]


def _all(*parts: Column) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def _registry() -> list[Hypothesis]:
    gap, big = F.col("gap_pct"), F.abs(F.col("gap_pct"))
    c = F.col

    def h(name, why, needs, direction, met):
        return Hypothesis(name, why, ("gap_pct", *needs) if "gap_pct" not in needs else needs, direction, met if callable(met) and not isinstance(met, Column) else lambda _: met)

    def delivery(columns: set[str]) -> Column:
        base = _all(gap > 0.5, c("delivery_z20") > 1)
        return base & (c("sector_rs_momentum") > 0) if "sector_rs_momentum" in columns else base

    def overshoot(columns: set[str]) -> Column:
        return F.abs(gap - F.coalesce(c("gift_premium_pct"), F.lit(0.0))) > 1.5

    # The thresholds of the fifteen hypotheses.
    return [
        h("H01_delivery_gap_continuation", "gaps up on real delivery go on", ("delivery_z20",), 1, delivery),
        h("H02_fii_positioning_fade", "gaps down against long foreign positions revert", ("fii_fut_long_short",), 1, _all(gap < -0.5, c("fii_fut_long_short") > 1.5)),
        h("H03_earnings_gap_drift", "gaps on earnings drift on", ("earnings_today", "gap_dir"), 0, _all(c("earnings_today") == 1, big > 1)),
        h("H04_ban_exit_squeeze", "stocks rise after a ban ends", ("fno_ban_exit",), 1, c("fno_ban_exit") == 1),
        h("H05_short_squeeze", "gaps up squeeze heavy shorts", ("si_pctile_90d",), 1, _all(gap > 0.5, c("si_pctile_90d") > 0.8)),
        h("H06_bulk_deal_breakout", "bulk buying above the last high goes on", ("bulk_deal_net5d", "dist_prev_high"), 1, _all(c("bulk_deal_net5d") > 0, c("dist_prev_high") > 0)),
        h("H07_gap_overshoot_fade", "gaps far beyond the index premium fade", ("gift_premium_pct",), -1, overshoot),
        h("H08_high_vix_reversion", "washed-out stocks bounce in high volatility", ("zscore_20d", "vix_pctile_1y"), 1, _all(c("zscore_20d") < -2, c("vix_pctile_1y") > 0.7)),
        h("H09_index_inclusion_drift", "index funds buy inclusions", ("index_inclusion_window",), 1, c("index_inclusion_window") == 1),
        h("H10_post_holiday_gap_fade", "gaps after holidays fade", ("post_holiday",), -1, _all(c("post_holiday") == 1, big > 0.75)),
        h("H11_long_buildup_continuation", "gaps up on long build-up go on", ("fut_long_buildup",), 1, _all(gap > 0.5, c("fut_long_buildup") == 1)),
        h("H12_idiosyncratic_gap_fade", "gaps the market doesn't share fade", ("gap_idiosyncratic",), -1, F.abs("gap_idiosyncratic") > 1),
        h("H13_delivery_spike_reversal", "heavy delivery into a fall is absorbed", ("delivery_z20", "ret_1d"), 1, _all(c("delivery_z20") > 2, c("ret_1d") < -1)),
        h("H14_pledge_distress_momentum", "gaps down with rising pledges go on", ("pledge_chg_90d",), -1, _all(gap < -0.5, c("pledge_chg_90d") > 5)),
        h("H15_global_riskoff_fade", "gaps down on a foreign scare revert", ("usvix_ret_1d",), 1, _all(gap < -0.75, c("usvix_ret_1d") > 10)),
    ]


def run_hypotheses(panel: DataFrame, target: str, s: Settings = SETTINGS, p_values: bool = True, least: tuple[int, int] = (100, 30)) -> DataFrame:
    """(hypothesis, why, status, n_train, n_test, train_mean, oos_mean, train_t, oos_t, oos_hit, confirmed), in one pass over the panel."""
    have, train = set(panel.columns), F.col("date") <= F.lit(s.train_end).cast("date")
    all_of = _registry()
    usable = [x for x in all_of if set(x.needs) <= have]
    listed = panel.sparkSession.createDataFrame([(x.name, x.why, set(x.needs) <= have) for x in all_of], "hypothesis string, why string, _usable boolean")
    y = F.col(target).cast("double")
    aim = {1: y, -1: -y, 0: y * F.col("gap_dir")} if "gap_dir" in have else {1: y, -1: -y}
    each = F.array(*(F.when(F.coalesce(x.met(have), F.lit(False)), F.struct(F.lit(x.name).alias("hypothesis"), aim[x.direction].alias("ret"))) for x in usable)) if usable else F.array().cast("array<struct<hypothesis:string,ret:double>>")
    members = panel.select("date", F.explode(F.filter(each, lambda v: v.isNotNull())).alias("v")).select("date", "v.*").withColumn("_train", train)
    m = edge_metrics(members, ["hypothesis", "_train"], p_values=p_values)
    a = m.filter("_train").select("hypothesis", F.col("n").alias("n_train"), F.col("mean_ret").alias("train_mean"), F.col("t_stat").alias("train_t"))
    b = m.filter("NOT _train").select("hypothesis", F.col("n").alias("n_test"), F.col("mean_ret").alias("oos_mean"), F.col("t_stat").alias("oos_t"), F.col("win_rate").alias("oos_hit"))
    out = listed.join(a, "hypothesis", "left").join(b, "hypothesis", "left").fillna({"n_train": 0, "n_test": 0})
    enough = (F.col("n_train") >= least[0]) & (F.col("n_test") >= least[1])
    status = F.when(~F.col("_usable"), "missing data").when(~enough, "too few events").otherwise("tested")
    ok = enough & (F.col("train_mean") > 0) & (F.col("oos_mean") > 0) & (F.col("oos_t") >= 1.5)
    return out.select("hypothesis", "why", status.alias("status"), "n_train", "n_test", "train_mean", "oos_mean", "train_t", "oos_t", "oos_hit", F.coalesce(ok, F.lit(False)).alias("confirmed"))
