"""Rank-history summary and the archive of expired items."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartlake.config import RankingConfig
from chartlake.functions.coerce import as_ts
from chartlake.functions.text import normalize_text_columns
from chartlake.operators.catalog import prune_children, upsert_by_key
from chartlake.operators.charts import RANK_HISTORY_COLUMNS, SCORE_DIGITS, chart_order, cutoff
from chartlake.operators.ordinal import ordinals_of
from chartlake.operators.scoring import score_songs
from chartlake.session import materialize

CHART_BANDS = (10, 50, 200)
# Ranges of scores in one unit of score, for ranks.
SCORE_RANGES = 16
PEAKS = ("play_count", "upvote_count", "comment_count", "adjusted_comment_count")


# Columns of the archive, in order.
ARCHIVE_COLUMNS = (
    "archived_at", "archive_reason", "id", "title", "handle", "display_name", "user_id",
    "created_at", "first_seen_at", "last_checked_at",
    "play_count", "upvote_count", "comment_count", "adjusted_comment_count",
    "comment_quality_ratio", "meaningful_count", "generic_count", "mention_only_count", "emoji_only_count", "flag_count",
    "final_rank", "best_rank", "best_rank_at", "first_charted_at", "last_charted_at",
    "top10_count", "top50_count", "top200_count", "chart_in_count",
    "final_trend_score", "final_base_score", "final_growth_score", "final_freshness_score",
    "best_trend_score", "best_score_at",
    "peak_play_count", "peak_upvote_count", "peak_comment_count", "peak_adjusted_comment_count",
    "model", "major_model_version", "display_tags", "duration", "lyrics", "prompt", "gpt_description_prompt",
    "song_url", "audio_url", "image_url", "source",
    "integrated_lufs", "true_peak_db", "loudness_gain_db", "loudness_target_lufs", "loudness_true_peak_ceiling_db",
    "loudness_checked_at", "loudness_status", "loudness_error", "loudness_audio_url_hash",
    "loudness_input_lra", "loudness_input_thresh", "loudness_target_offset",
)
TEXT_SUFFIXES = ("_url", "_hash", "_status", "_error", "_reason", "_prompt", "_tags", "_version")


def _absent(name: str) -> Column:
    """Null of the type an archive column has."""
    if name.endswith("_at"):
        return F.lit(None).cast("timestamp_ntz")
    words = ("title", "handle", "display_name", "user_id", "model", "lyrics", "prompt", "source")
    text = name in words or name.endswith(TEXT_SUFFIXES)
    return F.lit(None).cast("string" if text else "double")


def archive_layout(rows: DataFrame) -> DataFrame:
    """The archive columns in order; those that ``rows`` lacks are null."""
    return rows.select(*[F.col(c) if c in rows.columns else _absent(c).alias(c) for c in ARCHIVE_COLUMNS])


def rank_history_summary(rank_history: DataFrame) -> DataFrame:
    """Per id: best rank and score with their times, first/last capture, band counts.

    Of equally good captures the earliest wins.
    """
    rank, score, at = F.col("rank"), F.col("trend_score"), F.col("captured_at")
    return rank_history.groupBy("id").agg(
        F.min(rank).alias("best_rank_history"),
        F.min_by(at, F.when(rank.isNotNull(), F.struct(rank, at))).alias("best_rank_at"),
        F.max(score).alias("best_trend_score_history"),
        F.min_by(at, F.when(score.isNotNull(), F.struct(-score, at))).alias("best_score_at_history"),
        F.min(at).alias("first_charted_at"),
        F.max(at).alias("last_charted_at"),
        *[F.count_if(rank <= n).alias(f"top{n}_count") for n in CHART_BANDS],
        F.count(rank).alias("chart_in_count"),
    )


def split_expired(db: DataFrame, as_of: str, days: int = 4) -> tuple[DataFrame, DataFrame]:
    """(expired, active); items without a creation time stay active."""
    limit = cutoff(as_of, days)
    expired = db.where(F.col("created_at") < limit)
    active = db.where(F.col("created_at").isNull() | (F.col("created_at") >= limit))
    return expired, active


def expired_with_rank(db: DataFrame, hist: DataFrame, as_of: str, cfg=RankingConfig()) -> DataFrame:
    """Scores of the expired items with their rank in the whole catalogue.

    The scores of the catalogue are stored once; only ranges of scores that hold an
    expired item are put in order.
    """
    scores = ("trend_score", "base_score", "growth_score", "freshness_score")
    scored = materialize(score_songs(db, hist, as_of, cfg).select("id", "created_at", *scores))
    coarse = F.floor(F.round("trend_score", SCORE_DIGITS) * SCORE_RANGES)
    expired = F.col("created_at") < cutoff(as_of, cfg.max_age_days)
    return ordinals_of(scored, expired, chart_order(), coarse, "computed_rank")


def archive_rows(
    db: DataFrame, hist: DataFrame, rank_history: DataFrame, as_of: str, cfg=RankingConfig()
) -> DataFrame:
    """Final, best and peak values of every expired item."""
    expired, _ = split_expired(db, as_of, cfg.max_age_days)
    scored = expired_with_rank(db, hist, as_of, cfg).select(
        "id",
        "computed_rank",
        F.col("trend_score").alias("final_trend_score"),
        F.col("base_score").alias("final_base_score"),
        F.col("growth_score").alias("final_growth_score"),
        F.col("freshness_score").alias("final_freshness_score"),
    )
    summary = rank_history_summary(rank_history)

    def stored(name: str, kind: str = "double"):
        return F.col(f"_s_{name}").cast(kind) if name in db.columns else F.lit(None).cast(kind)

    renamed = {
        f"_s_{c}": F.col(c)
        for c in ("best_rank", "best_trend_score", "best_score_at", "current_rank", *[f"peak_{p}" for p in PEAKS])
        if c in db.columns
    }
    kept = expired.withColumns(renamed).drop(*[c[3:] for c in renamed]) if renamed else expired
    out = kept.join(summary, "id", "left").join(scored, "id", "left")
    out = out.withColumns(
        {
            "archived_at": as_ts(as_of),
            "archive_reason": F.lit(f"older_than_{cfg.max_age_days}d"),
            "final_rank": F.coalesce(F.col("computed_rank").cast("double"), stored("current_rank")),
        }
    )
    out = out.withColumns(
        {
            "best_rank": F.least(
                stored("best_rank"), F.col("final_rank"), F.col("best_rank_history").cast("double")
            ),
            "best_trend_score": F.greatest(
                stored("best_trend_score"), F.col("final_trend_score"), F.col("best_trend_score_history")
            ),
            "best_score_at": F.coalesce(
                stored("best_score_at", "timestamp_ntz"), F.col("best_score_at_history"), as_ts(as_of)
            ),
            **{f"top{n}_count": F.coalesce(F.col(f"top{n}_count"), F.lit(0)) for n in CHART_BANDS},
            "chart_in_count": F.coalesce(F.col("chart_in_count"), F.lit(0)),
            **{
                f"peak_{p}": F.greatest(stored(f"peak_{p}"), F.col(p).cast("double"))
                for p in PEAKS
                if p in db.columns
            },
        }
    )
    return out.drop("computed_rank", "best_rank_history", "best_trend_score_history", "best_score_at_history", *renamed)


def archive_expired(
    db: DataFrame,
    hist: DataFrame,
    rank_history: DataFrame | None,
    archive: DataFrame | None,
    as_of: str,
    cfg=RankingConfig(),
) -> dict[str, DataFrame]:
    """Move expired items to the archive and prune their history rows.

    Archive rows have the archive's columns and clean texts; an item archived before
    is replaced. Without a rank history the items have no chart figures.
    """
    ranks = empty_rank_history(db) if rank_history is None else rank_history
    rows = archive_layout(archive_rows(db, hist, ranks, as_of, cfg))
    if archive is not None:
        rows = upsert_by_key(archive, rows, ["id"])
    _, active = split_expired(db, as_of, cfg.max_age_days)
    out = {"archive": normalize_text_columns(rows), "songs": active, "song_history": prune_children(hist, active)}
    if rank_history is not None:
        out["rank_history"] = prune_children(rank_history, active)
    return out


def empty_rank_history(db: DataFrame) -> DataFrame:
    kinds = {"captured_at": "timestamp_ntz", "id": "string", "rank": "bigint"}
    schema = ", ".join(f"{c} {kinds.get(c, 'double')}" for c in RANK_HISTORY_COLUMNS)
    return db.sparkSession.createDataFrame([], schema)
