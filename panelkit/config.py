"""Thresholds, windows and grid settings, in one place."""

from __future__ import annotations

from dataclasses import dataclass

# The published defaults of the reports.
BIN_MIN = 5
LAG_BINS = (1, 2, 3, 6, 12, 24, 36, 48)
ROLL_BINS = (3, 6, 12, 24, 36, 48)
KNN_LAGS = (1, 3, 12)
HORIZONS_MIN = (15, 60)
CENTER = (48.853, 2.349)
ACF_LAGS = 144
EXPLAIN_HIST_BINS = 60
QQ_POINTS = 512
EMA_ALPHA = 2.0 / 8.0


@dataclass(frozen=True)
class PanelConfig:
    """Settings shared by the operators and the reports built from them."""

    bin_min: int = BIN_MIN
    tz: str = "Europe/Paris"
    # Rows per (station, block): ordered work is cut into blocks of this many bins.
    block_bins: int = 4096
    penury_threshold: float = 2.0
    saturation_threshold: float = 2.0
    last_days: int = 7
    ref_days: int = 28
    # data health
    freshness_slo_min: float = 5.0
    coverage_alert_pct: float = 98.0
    duplicate_alert_pct: float = 1.0
    flat_steps: int = 6
    latency_cap_min: int = 72 * 60
    anomaly_topk: int = 200
    # drift
    psi_bins: int = 20
    ks_points: int = 201
    psi_medium: float = 0.10
    psi_high: float = 0.25
    # evaluation
    error_run_threshold: float = 4.0
    error_run_topk: int = 64
    hist_bins: int = 40
    nominal: float = 0.90
    # stations
    min_bins_keep: int = 50
    # status board
    forecast_ok_min: float = 7.0
    forecast_warn_min: float = 20.0
    weather_ok_min: float = 5.0
    weather_warn_min: float = 12.0

    @property
    def step_s(self) -> int:
        return self.bin_min * 60

    @property
    def bins_per_hour(self) -> int:
        return 60 // self.bin_min

    @property
    def bins_per_day(self) -> int:
        return 24 * 60 // self.bin_min
