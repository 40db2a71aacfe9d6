"""Parameters of every operator, as frozen dataclasses.

Limits of work (``max_rows``, ``max_items``, ``QualityConfig.top_n``) are off unless
a caller sets them.

The numbers are fixed values of the chart being computed; callers override them
per call instead of through environment variables.
"""
from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class RankingConfig:
    """Trend score: base + growth + freshness."""

    retention_hours: int = 96
    max_age_days: int = 4
    growth_window_hours: int = 3
    play_weight: float = 1.0
    like_weight: float = 3.0
    comment_weight: float = 4.0
    growth_weight: float = 1.5
    freshness_weight: float = 35.0
    freshness_power: float = 1.35
    growth_play_weight: float = 0.4
    growth_like_weight: float = 2.0
    growth_comment_weight: float = 3.0


@dataclass(frozen=True)
class CommunityScoreConfig:
    """Score of community uploads: log counters + linear-decay freshness."""

    play_weight: float = 1.0
    like_weight: float = 3.0
    comment_weight: float = 4.0
    freshness_weight: float = 30.0
    freshness_days: int = 7
    freshness_power: float = 1.25


@dataclass(frozen=True)
class ChartConfig:
    """Sizes of the served lists."""

    top_n: int = 200
    new_limit: int = 300
    crew_limit: int = 300
    history_points: int = 80
    outlier_sigma: float = 6.0
    outlier_log: bool = True


@dataclass(frozen=True)
class TierConfig:
    """Refresh tiers: hours between checks, backoff and freeze thresholds."""

    retention_days: int = 4
    hot_hours: float = 0
    playlist_hours: float = 24
    warm_hours: float = 6
    cold_hours: float = 72
    frozen_hours: float = 168
    backoff_failures: int = 3
    backoff_hours: float = 24
    freeze_failures: int = 10
    max_rows: int | None = None
    warm_handles: tuple[str, ...] = field(default_factory=tuple)

    def hours(self) -> dict[str, float]:
        return {
            "hot": self.hot_hours,
            "playlist": self.playlist_hours,
            "warm": self.warm_hours,
            "cold": self.cold_hours,
            "frozen": self.frozen_hours,
        }


@dataclass(frozen=True)
class QualityConfig:
    """Comment-quality analysis.

    ``empty_policy`` decides what an item without analysed comments gets:
    ``keep`` leaves its comment count, ``zero`` discounts it completely.
    """

    top_n: int | None = None
    empty_policy: str = "keep"


@dataclass(frozen=True)
class LoudnessConfig:
    target_lufs: float = -14.0
    true_peak_ceiling_db: float = -1.0
    max_boost_db: float = 6.0
    max_cut_db: float = -12.0
    max_items: int | None = None
    priority_top_n: int = 300


@dataclass(frozen=True)
class LinkConfig:
    """Which item links are accepted and how item links are built."""

    hosts: tuple[str, ...] = ("tracks.example.com", "www.tracks.example.com")
    item_url_prefix: str = "https://tracks.example.com/song/"


@dataclass(frozen=True)
class CrewConfig:
    """Members whose items get their own list."""

    handles: tuple[str, ...] = ()
    user_ids: tuple[str, ...] = ()
    display_names: tuple[str, ...] = ()
