"""Thresholds of the engine in one place; every operator takes them as parameters with these defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    # Vote depths, clocks and ranges that results depend on.
    vote_depth: int = 15
    temperature_depth: int = 5
    vote_seconds: int = 2700
    stale_passes: int = 15
    peer_quorum: int = 3
    peer_deviation: int = 30
    min_sightings: int = 2
    stale_minutes: int = 60
    almanac_stale_minutes: int = 1440
    trust_saturation: int = 6
    trust_high: float = 0.66
    trust_medium: float = 0.33
    uncertain_below: float = 0.6
    confidence_floor: float = 0.5
    duplicate_ratio: float = 0.97
    update_ratio: float = 0.75
    dedup_history: int = 100
    gate_similarity: float = 0.995
    gate_history: int = 400
    gate_minutes: int = 45
    repeat_run: int = 6
    repeat_words: int = 12
    repeat_ratio: float = 0.35
    speech_dbfs: float = -35.0
    silence_s: float = 1.0
    min_speech_s: float = 1.0
    max_segment_s: float = 28.0
    pre_roll_s: float = 0.2
    frame_s: float = 0.02
    alert_pre_buffer_s: int = 120
    prune_hours: int = 24
    min_window_obs: int = 6
    min_sky_obs: int = 3
    wet_inches: float = 0.005
    ranges: dict = field(
        default_factory=lambda: {
            "temperature_f": (-60, 130),
            "dewpoint_f": (-60, 100),
            "humidity_pct": (0, 100),
            "pressure_in": (25.0, 35.0),
            "wind_speed_mph": (0, 120),
            "high_f": (-60, 130),
            "low_f": (-60, 84),
            "steady_f": (-60, 130),
            "precip_pct": (0, 100),
            "precip_year_in": (0.0, 200.0),
            "precip_departure_in": (-100.0, 100.0),
            "normal_precip_week_in": (0.0, 20.0),
            "heating_degree_days": (0, 100),
            "cooling_degree_days": (0, 100),
        }
    )


DEFAULTS = Settings()
