"""Thresholds of the coverage engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    rollup_minutes: int = 180
    station_resolution: int = 8
    global_resolution: int = 7
    stationary_resolution: int = 10
    forget_seconds: int = 12 * 3600
    max_gap: int = 60
    moved_km: float = 2.0
    jitter_km: float = 0.1
    station_expiry_days: int = 31
    graph_days: int = 60
    purge_limit: float = 0.02
    history: int = 250
    shown_tokens: int = 30
    top: int = 5
    #: ``as_coded`` tests any non-zero speed for standing still; ``intended`` tests speeds below 1.
    stationary_mode: str = "as_coded"


DEFAULT = Config()
