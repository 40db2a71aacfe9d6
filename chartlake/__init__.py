"""chartlake: popularity-chart analytics as PySpark DataFrame functions.

Every operator has the form ``f(df, ..., cfg, as_of) -> DataFrame``: lazy, pure,
and free of hidden "now" values, so a result is a function of its inputs.
"""
from chartlake.config import (
    ChartConfig,
    LoudnessConfig,
    QualityConfig,
    RankingConfig,
    TierConfig,
)
from chartlake.session import build_session, prepare_session

__all__ = [
    "ChartConfig",
    "LoudnessConfig",
    "QualityConfig",
    "RankingConfig",
    "TierConfig",
    "build_session",
    "prepare_session",
]
