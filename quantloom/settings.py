"""One immutable bag of parameters shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Thresholds of the research protocol.
    forecast_horizon: int = 1
    min_bars: int = 252
    winsor_pct: float = 0.01
    max_null_share: float = 0.30
    min_variance: float = 1e-6
    max_row_null_share: float = 0.50
    near_duplicate_rho: float = 0.95
    fm_min_stocks: int = 30
    fm_min_periods: int = 10
    nw_lags: int = 3
    n_groups: int = 5
    min_abs_t: float = 2.0
    min_abs_ic: float = 0.01
    min_abs_icir: float = 0.10
    weak_abs_t: float = 2.5
    prod_abs_t: float = 3.0
    prod_abs_icir: float = 0.30
    prod_abs_ic: float = 0.03
    prod_min_periods: int = 30
    backtest_cost_bps: float = 30.0
    limit_pct: float = 0.10
    min_names: int = 50
    train_months: int = 27
    val_months: int = 12
    test_months: int = 3
    purge_days: int = 1
    embargo_days: int = 2
    min_test_days: int = 30

    # Physical layout: no window task ever sorts more rows than these allow.
    block_rows: int = 8192
    halo_back: int = 1024
    halo_forward: int = 64
    chunk_unit: str = "month"
    heavy_group_rows: int = 500_000
    # Values of wide rows that may cross the network, and lie on disk, at once.
    wide_bytes: int = 16 << 30


DEFAULTS = Settings()
