"""Thresholds of the jobs, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DetectorConfig:
    poll_minutes: int = 2
    lookback_minutes: int = 60
    ground_velocity_ms: float = 30.0
    ground_altitude_m: float = 300.0
    missed_departure_altitude_m: float = 3000.0
    missed_departure_max_gap_h: int = 12
    airport_radius_km: float = 50.0
    proximity_altitude_m: float = 500.0
    proximity_radius_km: float = 8.0
    retention_days: int = 30
    stale_hours: int = 24
    tail_rows: int = 15
    lookback_rows: int = 15
    head_rows: int = 5

    @property
    def gap_seconds(self) -> int:
        return 4 * 60 * self.poll_minutes


#: For the test tables, whose positions are hours apart.
SPARSE = DetectorConfig(poll_minutes=360, missed_departure_max_gap_h=48)
SPARSE_REPLAY = DetectorConfig(poll_minutes=360, missed_departure_max_gap_h=48, lookback_rows=5)
