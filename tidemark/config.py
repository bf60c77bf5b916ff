"""Parameters of the research engine, in one frozen object."""

from __future__ import annotations

from dataclasses import dataclass


# Parameters that results depend on.
@dataclass(frozen=True)
class Settings:
    market_open: str = "09:15"
    market_close: str = "15:30"
    time_zone: str = "Asia/Kolkata"
    gap_min_pct: float = 0.5
    gap_go_horizons: tuple[int, ...] = (15, 30, 60, 240)
    mr_zscore_entry: float = 2.0
    mr_horizons: tuple[int, ...] = (15, 30, 60, 120)
    train_end: str = "2021-12-31"
    min_events: int = 100
    fdr_alpha: float = 0.05
    n_buckets: int = 5
    combo_max_factors: int = 3
    combo_top_single: int = 15
    gauntlet_top_single: int = 10
    decay_top_rules: int = 20
    regime_top_factors: int = 30
    importance_repeats: int = 5
    gp_trials_each: int = 50
    cost_pct: float = 0.06
    n_cv_folds: int = 5
    embargo_days: int = 5
    n_permutations: int = 500
    n_bootstrap: int = 1000
    bootstrap_block: int = 20
    cscv_splits: int = 8
    pbo_max: float = 0.5
    gp_population: int = 200
    gp_generations: int = 12
    gp_max_depth: int = 4
    gp_top_keep: int = 10
    gp_seed: int = 42
    tb_up_mult: float = 2.0
    tb_dn_mult: float = 1.0
    tb_max_min: int = 120
    audit_jump_pct: float = 25.0
    audit_stale_days: int = 5
    audit_min_history_days: int = 250
    stt_pct: float = 0.025
    stamp_broker_pct: float = 0.007
    spread_base_pct: float = 0.03
    impact_coef: float = 0.1
    trade_value: float = 1_000_000.0
    open_auction_mult: float = 2.0
    gap_slippage_coef: float = 0.02
    default_traded_value: float = 5e8
    port_max_concurrent: int = 10
    port_corr_max: float = 0.7
    port_capacity_pct: float = 5.0
    boundary_dates: tuple[str, ...] = ("2019-12-31", "2021-12-31", "2023-06-30")
    boundary_min_pass: int = 2
    meta_min_events: int = 300
    meta_prob_threshold: float = 0.55
    kelly_fraction: float = 0.25
    n_regimes: int = 3
    regime_columns: tuple[str, ...] = ("nifty_ret_5d", "vix_level", "vix_pctile_1y", "nifty_above_50dma", "sp500_overnight", "mkt_gap_median", "fii_net_5d")
    cusum_threshold: float = 8.0
    cusum_drift: float = 0.25
    mechanical_actions: tuple[str, ...] = ("split", "bonus", "demerger", "rights", "dividend", "spinoff", "consolidation", "face_value_change")
    panel_keys: tuple[str, ...] = ("symbol", "date", "mr_time", "cost_pct")
    outcome_prefixes: tuple[str, ...] = ("cont_", "go_", "revert_", "rev_", "tb_", "filled_")
    anomaly_candidates: tuple[str, ...] = ("rvol_20d", "opt_oi_change", "fut_oi_change", "opt_iv", "news_count", "opt_pcr")

    @property
    def statutory_pct(self) -> float:
        return self.stt_pct + self.stamp_broker_pct


SETTINGS = Settings()
