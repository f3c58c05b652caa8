"""Tunables and fixed vocabularies shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass

# The vocabularies every table uses.
OUTCOMES = ("boarded", "waited_1", "waited_2plus", "filled", "cancelled", "unknown")
REPORTED_OUTCOMES = ("boarded", "filled", "waited_1", "waited_2plus", "cancelled")
BANDS = ("empty", "light", "moderate", "heavy", "overflowing")
DAY_TYPES = ("weekday", "friday", "saturday", "sunday_holiday")
SEASONS = ("peak_summer", "shoulder", "winter")
# A day type and the one that stands in for it when history is thin.
DAY_TYPE_PARTNER = {
    "weekday": "friday",
    "friday": "weekday",
    "saturday": "sunday_holiday",
    "sunday_holiday": "saturday",
}
MOVING_WORDS = ("under way", "underway", "en route")
STOPPED_WORDS = ("in port", "stopped", "docked")
DECK_FULLNESS = ("room", "half", "nearly_full", "full")
REPORT_SOURCES = ("web", "checkin")

# Rungs of the widening search, narrowest first.
RUNGS = ("exact", "any_season", "wider_time", "any_long_weekend", "grouped_days")


@dataclass(frozen=True)
class Params:
    """Defaults of every operator; pass a changed copy to tune one deployment."""

    zone: str = "America/Vancouver"

    # evidence merge
    vessel_capacity: int = 125
    lookback_minutes: int = 120
    grace_minutes: int = 20
    settle_minutes: int = 12
    post_window_minutes: int = 45
    neighbour_gap_minutes: int = 5
    residual_threshold: int = 5
    note_wait_minutes: int = 15

    # comparable history
    min_sample: int = 5
    max_samples: int = 5
    tolerance_minutes: int = 15
    wide_tolerance_minutes: int = 60
    curve_bucket_minutes: int = 15
    min_boarded_reports: int = 2

    # retention
    keep_days: int = 400
    thin_after_days: int = 120
    keep_per_hour: int = 1
    thin_unread_after_days: int = 45

    # extraction
    model_version: str = "model"
    lane_version: str = "lane"
    extent_version: str = "extent"
    min_confidence: float = 0.35
    dark_luma: float = 24.0
    # Background of a camera-hour: days it looks back, frames it needs, frames it takes evenly spaced.
    background_days: int = 14
    min_background_frames: int = 40
    max_background_frames: int = 48
    essential_offsets: tuple[int, ...] = (-30, -10, 15, 30)
    essential_tolerance_minutes: int = 10
    on_demand_frames: int = 3
    on_demand_age_minutes: int = 90
    usd_per_m_input: float = 3.0
    usd_per_m_output: float = 15.0
    typical_input_tokens: int = 800
    typical_output_tokens: int = 40
    monthly_budget_usd: float = 5.0
    # Frames read in a day, by whatever path, before on-demand reading stops; None is no cap, 0 stops it.
    daily_frame_cap: int | None = 120

    # collection: whether cameras are polled or asked on demand, and how many frames one reading run takes
    scheduled_capture: bool = True
    max_frames_per_run: int = 200

    # ledger
    late_tolerance_minutes: int = 75
    same_departure_minutes: int = 15
    min_separation_minutes: int = 30

    # live board
    poll_minutes: int = 5
    tracker_fresh_minutes: int = 40
    outlook_room: float = 0.70
    outlook_tossup: float = 0.45

    # forecasts
    stale_forecast_hours: int = 24
    min_band_days: int = 20
    # Health calls a feed stale after this long without an issue.
    overdue_forecast_hours: int = 12
    # Numbers above this in a wind sentence are no speeds.
    fastest_wind_kt: int = 150

    # reports
    max_departure_drift_hours: int = 3
    max_queue_hours: int = 12
    max_reports_per_service: int = 50

    # interval joins: sub-keys a (terminal, hour) bucket is split into
    salts: int = 8

    @property
    def rung_words(self) -> dict[str, str]:
        """What each widening step says about itself."""
        return {
            "any_season": "widened to all seasons",
            "wider_time": f"widened to +/-{self.wide_tolerance_minutes} min",
            "any_long_weekend": (
                "widened to include days outside a long weekend, which behave differently"
            ),
        }
