"""Score kernels and loudness gain."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chartlake.config import CommunityScoreConfig, LoudnessConfig
from chartlake.functions.coerce import as_ts, clamp, col, hours_between, round_binary


def log_count(c: Column | str) -> Column:
    return F.log1p(F.greatest(col(c).cast("double"), F.lit(0.0)))


def community_score(plays, likes, comments, created_at, as_of: str, cfg=CommunityScoreConfig()) -> Column:
    """Log counters plus a freshness term; items dated in the future count as new."""
    age = F.greatest(hours_between(col(created_at), as_ts(as_of)), F.lit(0.0))
    decay = F.greatest(1.0 - age / F.lit(cfg.freshness_days * 24.0), F.lit(0.0))
    freshness = F.coalesce(F.pow(decay, F.lit(cfg.freshness_power)) * cfg.freshness_weight, F.lit(0.0))
    total = (
        F.coalesce(log_count(plays), F.lit(0.0)) * cfg.play_weight
        + F.coalesce(log_count(likes), F.lit(0.0)) * cfg.like_weight
        + F.coalesce(log_count(comments), F.lit(0.0)) * cfg.comment_weight
        + freshness
    )
    return F.round(total, 6)


def normalization_gain(lufs, true_peak, cfg=LoudnessConfig()) -> Column:
    """Gain towards the target, limited by the peak ceiling and clamped."""
    gain = F.least(F.lit(cfg.target_lufs) - col(lufs), F.lit(cfg.true_peak_ceiling_db) - col(true_peak))
    both = col(lufs).isNotNull() & col(true_peak).isNotNull()
    return F.when(both, round_binary(clamp(gain, cfg.max_cut_db, cfg.max_boost_db), 3))


def upload_gain(lufs, true_peak, cfg=LoudnessConfig()) -> Column:
    """Upload variant: peak-limited only, two digits."""
    gain = F.least(F.lit(cfg.target_lufs) - col(lufs), F.lit(cfg.true_peak_ceiling_db) - col(true_peak))
    return F.when(col(lufs).isNotNull() & col(true_peak).isNotNull(), round_binary(gain, 2))


def playback_factor(gain_db, clamped: bool = True) -> Column:
    """Linear playback factor of a gain in dB; no gain means factor 1."""
    factor = F.pow(F.lit(10.0), F.coalesce(col(gain_db), F.lit(0.0)) / 20.0)
    return clamp(factor, 0.05, 3.0) if clamped else factor


def play_qualifies(duration, position, ended=None, min_duration: float = 10.0, share: float = 0.30) -> Column:
    """A play counts from 30 % on; ``ended`` admits short items that ran through."""
    d = col(duration)
    reached = F.try_divide(col(position), d) >= share
    if ended is None:
        return F.coalesce((d >= min_duration) & reached, F.lit(False))
    return F.coalesce((d > 0) & reached, F.lit(False)) | F.coalesce(col(ended), F.lit(False))


def register_sql_functions(spark, cfg=CommunityScoreConfig()) -> None:
    """Temporary SQL function ``community_score(plays, likes, comments, created, as_of)``."""
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION community_score(
            plays BIGINT, likes BIGINT, comments BIGINT, created TIMESTAMP_NTZ, as_of TIMESTAMP_NTZ)
        RETURNS DOUBLE
        RETURN round(
            coalesce(ln(1 + greatest(plays, 0)), 0) * {cfg.play_weight}D
            + coalesce(ln(1 + greatest(likes, 0)), 0) * {cfg.like_weight}D
            + coalesce(ln(1 + greatest(comments, 0)), 0) * {cfg.comment_weight}D
            + coalesce(power(greatest(1D - greatest(timestampdiff(MICROSECOND, created, as_of), 0)
                / ({cfg.freshness_days} * 86400000000D), 0D), {cfg.freshness_power}D) * {cfg.freshness_weight}D, 0D), 6)"""
    )
