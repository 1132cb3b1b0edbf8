"""Thresholds of the analytics. Money is in rial, durations in seconds."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # flow bands and quality
    hot_threshold: int = 2_000_000_000
    plus_threshold: int = 1_000_000_000
    stale_after: int = 30
    gap_after: int = 30
    # an instrument unseen for this many days loses its previous-day reference
    keep_days: int = 30
    # a source time further ahead of the ingest time never moves the trading day
    future_guard: int = 3600
    # radar
    alpha: float = 0.02
    warm_up: int = 60
    z_threshold: float = 4.0
    min_value_rate: float = 1e6
    opening_skip: int = 15 * 60
    divergence_hot: int = 5_000_000_000
    divergence_flat: float = 0.2
    # market aggregates
    materiality: float = 0.01
    radar_keep: int = 50
    series_bars: int = 36
    lag_after: int = 30
    map_tiles: int = 40
    # ordered scans: at most this many rows of one instrument go to one task
    chunk_rows: int = 1 << 20


DEFAULT = Params()
