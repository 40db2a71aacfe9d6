"""Catalogue coercion, created_at repair, growth and trend scores, outliers."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartlake.config import LinkConfig, RankingConfig
from chartlake.functions.coerce import as_ts, clamp, hours_between, parse_ts, plus_hours, to_number
from chartlake.functions.scores import log_count
from chartlake.operators.skew import salted_join

# Columns of the catalogue by type.
TIME_COLUMNS = ("created_at", "first_seen_at", "last_checked_at", "comment_quality_checked_at")
COUNTERS = ("play_count", "upvote_count", "comment_count", "flag_count")
NUMERIC_COLUMNS = COUNTERS + (
    "adjusted_comment_count", "comment_quality_ratio", "analyzed_comment_count",
    "meaningful_count", "generic_count", "mention_only_count", "emoji_only_count",
    "previous_rank", "current_rank", "rank_change",
    "current_score", "base_score", "growth_score", "freshness_score",
    "best_rank", "best_trend_score", "peak_play_count", "peak_upvote_count",
    "peak_comment_count", "peak_adjusted_comment_count",
)
GROWTH_COLUMNS = ("play", "upvote", "comment")


def _numeric(df: DataFrame, name: str):
    """Double of a column: text goes through the number gate, numbers are cast."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return to_number(name, None)
    return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))


def _time(df: DataFrame, name: str):
    if isinstance(df.schema[name].dataType, T.StringType):
        return parse_ts(name)
    return F.col(name).cast("timestamp_ntz")


def prepare_catalog(df: DataFrame, links: LinkConfig = LinkConfig()) -> DataFrame:
    """Typed catalogue with defaults: missing counters 0, adjusted comments default
    to the raw count, quality ratio to 1, the link is derived from the id."""
    out = df.withColumns(
        {
            "id": F.col("id").cast("string"),
            **{c: _time(df, c) for c in TIME_COLUMNS if c in df.columns},
            **{c: _numeric(df, c) for c in NUMERIC_COLUMNS if c in df.columns},
        }
    )

    def present(name):
        return F.col(name) if name in out.columns else F.lit(None).cast("double")

    out = out.withColumns({c: F.coalesce(present(c), F.lit(0.0)) for c in COUNTERS})
    out = out.withColumns(
        {
            "adjusted_comment_count": F.coalesce(present("adjusted_comment_count"), F.col("comment_count")),
            "comment_quality_ratio": F.coalesce(present("comment_quality_ratio"), F.lit(1.0)),
        }
    )
    if "song_url" not in out.columns:
        out = out.withColumn("song_url", F.concat(F.lit(links.item_url_prefix), "id"))
    return out


def prepare_history(df: DataFrame) -> DataFrame:
    """Typed snapshots; missing counters are 0."""
    typed = {c: _time(df, c) for c in ("checked_at", "created_at") if c in df.columns}
    for c in COUNTERS:
        typed[c] = F.coalesce(_numeric(df, c), F.lit(0.0)) if c in df.columns else F.lit(0.0)
    return df.withColumns({"id": F.col("id").cast("string"), **typed})


def earliest_created(hist: DataFrame) -> DataFrame:
    """Earliest creation time per id; min is combined map-side."""
    return hist.where(F.col("created_at").isNotNull()).groupBy("id").agg(F.min("created_at").alias("_first_created"))


def restore_created_at(db: DataFrame, hist: DataFrame) -> DataFrame:
    """Fill missing creation times with the earliest one seen in the history."""
    return (
        db.join(earliest_created(hist), "id", "left")
        .withColumn("created_at", F.coalesce("created_at", "_first_created"))
        .drop("_first_created")
    )


def snapshot_key() -> Column:
    """Total order of snapshots as one decimal: time, then counters, then a hash.

    A decimal keeps the buffers of ``min_by`` primitive, and all counters of an id
    come from one row even where several snapshots have the same time.
    """
    counters = [F.coalesce(F.col(f"{c}_count").cast("double"), F.lit(0.0)) for c in GROWTH_COLUMNS]
    grown = F.least(counters[0] + counters[1] + counters[2], F.lit(999_999_999_999.0)).cast("decimal(12,0)")
    mark = F.pmod(F.xxhash64(*counters), F.lit(10_000_000_000)).cast("decimal(10,0)")
    micros = F.unix_micros(F.col("checked_at").cast("timestamp")).cast("decimal(17,0)")
    tie = (grown * F.lit(10_000_000_000).cast("decimal(11,0)")).cast("decimal(22,0)") + mark
    whole = (micros * F.expr("CAST('10000000000000000000000' AS DECIMAL(23,0))")).cast("decimal(38,0)")
    return (whole + tie).cast("decimal(38,0)")


def growth_features(db: DataFrame, hist: DataFrame, cfg: RankingConfig = RankingConfig()) -> DataFrame:
    """Velocity per hour and delta per window of three counters, per id.

    Uses the snapshots from ``created_at + window`` on. First and last snapshot
    come from ``min_by``/``max_by`` on primitive buffers, so the aggregate is a
    hash aggregate combined map-side and needs no sort within an id. Ids with
    very many snapshots are spread over tasks by the join.
    """
    spans = _tail(db, hist, cfg).groupBy("id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("checked_at").alias("_t0"),
        F.max("checked_at").alias("_t1"),
        *[F.min_by(f"{c}_count", "_at").cast("double").alias(f"_{c}0") for c in GROWTH_COLUMNS],
        *[F.max_by(f"{c}_count", "_at").cast("double").alias(f"_{c}1") for c in GROWTH_COLUMNS],
    )
    return with_growth(db, spans, cfg)


def _tail(db: DataFrame, hist: DataFrame, cfg: RankingConfig) -> DataFrame:
    """Snapshots from ``created_at + window`` on, with their place in time (``_at``)."""
    anchors = db.select("id", plus_hours("created_at", cfg.growth_window_hours).alias("_anchor")).where(F.col("_anchor").isNotNull())
    snapshots = hist.select("id", "checked_at", *[f"{c}_count" for c in GROWTH_COLUMNS])
    tail = salted_join(snapshots, anchors, ["id"]).where(F.col("checked_at") >= F.col("_anchor"))
    return tail.withColumn("_at", snapshot_key())


def with_growth(db: DataFrame, spans: DataFrame, cfg: RankingConfig = RankingConfig()) -> DataFrame:
    """Growth columns of items from the spans of their snapshots."""
    hours = hours_between("_t0", "_t1")
    usable = (F.col("_n") >= 2) & (hours > 0)
    velocity = {
        f"{c}_velocity_per_hour": F.when(
            usable, F.try_divide(F.greatest(F.lit(0.0), F.col(f"_{c}1") - F.col(f"_{c}0")), hours)
        )
        for c in GROWTH_COLUMNS
    }
    rates = spans.select("id", *[v.alias(k) for k, v in velocity.items()])
    joined = db.join(rates, "id", "left")
    joined = joined.withColumns({k: F.coalesce(k, F.lit(0.0)) for k in velocity})
    return joined.withColumns(
        {f"{c}_delta_window": F.col(f"{c}_velocity_per_hour") * float(cfg.growth_window_hours) for c in GROWTH_COLUMNS}
    )


# Number of snapshots of an item after its anchor, and the first and the last of them with
# their places in time. States of separate snapshots add up to the state of all.
GROWTH_STATE = T.StructType(
    [
        T.StructField("id", T.StringType()), T.StructField("_n", T.LongType()),
        T.StructField("_t0", T.TimestampNTZType()), T.StructField("_t1", T.TimestampNTZType()),
        T.StructField("_at0", T.DecimalType(38, 0)), T.StructField("_at1", T.DecimalType(38, 0)),
        *[T.StructField(f"_{c}{i}", T.DoubleType()) for i in (0, 1) for c in GROWTH_COLUMNS],
    ]
)


def growth_state(db: DataFrame, hist: DataFrame, cfg: RankingConfig = RankingConfig()) -> DataFrame:
    """State of the growth of each item with a snapshot after its anchor; ``with_growth`` reads it."""
    state = _tail(db, hist, cfg).groupBy("id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("checked_at").alias("_t0"), F.max("checked_at").alias("_t1"),
        F.min("_at").alias("_at0"), F.max("_at").alias("_at1"),
        *[F.min_by(f"{c}_count", "_at").cast("double").alias(f"_{c}0") for c in GROWTH_COLUMNS],
        *[F.max_by(f"{c}_count", "_at").cast("double").alias(f"_{c}1") for c in GROWTH_COLUMNS],
    )
    return state.select(*GROWTH_STATE.names)


def merge_growth(old: DataFrame, new: DataFrame) -> DataFrame:
    """State of the snapshots of two states."""
    merged = old.unionByName(new).groupBy("id").agg(
        F.sum("_n").alias("_n"), F.min("_t0").alias("_t0"), F.max("_t1").alias("_t1"),
        *[F.min_by(f"_{c}0", "_at0").alias(f"_{c}0") for c in GROWTH_COLUMNS],
        *[F.max_by(f"_{c}1", "_at1").alias(f"_{c}1") for c in GROWTH_COLUMNS],
        F.min("_at0").alias("_at0"), F.max("_at1").alias("_at1"),
    )
    return merged.select(*GROWTH_STATE.names)


def restored_catalog(db: DataFrame, hist: DataFrame) -> DataFrame:
    """Coerced catalogue with repaired creation times (``hist`` is prepared)."""
    return restore_created_at(prepare_catalog(db), hist)


def score_items(view: DataFrame, hist: DataFrame, as_of: str, cfg: RankingConfig = RankingConfig()) -> DataFrame:
    """Age, freshness, growth and score columns of prepared items."""
    age = F.greatest(hours_between("created_at", as_ts(as_of)), F.lit(0.0))
    view = view.withColumn("age_hours", F.when(F.col("created_at").isNotNull(), age))
    left = F.greatest(F.lit(float(cfg.retention_hours)) - F.col("age_hours"), F.lit(0.0))
    view = view.withColumn("remaining_hours", F.when(F.col("age_hours").isNotNull(), left))
    view = growth_features(view, hist, cfg).withColumns(
        {
            "freshness": clamp(F.col("remaining_hours") / float(cfg.retention_hours), 0.0, 1.0),
            "effective_comment_count": F.greatest(F.col("adjusted_comment_count"), F.lit(0.0)),
        }
    )
    view = view.withColumns(
        {
            "freshness_score": F.pow("freshness", F.lit(cfg.freshness_power)) * cfg.freshness_weight,
            "base_score": log_count("play_count") * cfg.play_weight
            + log_count("upvote_count") * cfg.like_weight
            + log_count("effective_comment_count") * cfg.comment_weight,
            "growth_score_raw": log_count("play_delta_window") * cfg.growth_play_weight
            + log_count("upvote_delta_window") * cfg.growth_like_weight
            + log_count("comment_delta_window") * cfg.growth_comment_weight,
        }
    )
    view = view.withColumn("growth_score", F.col("growth_score_raw") * cfg.growth_weight)
    return view.withColumn("trend_score", F.col("base_score") + F.col("growth_score") + F.col("freshness_score"))


def score_songs(db: DataFrame, hist: DataFrame, as_of: str, cfg: RankingConfig = RankingConfig()) -> DataFrame:
    """Trend score of the whole catalogue at ``as_of``.

    Items without any known creation time keep a null freshness and trend score.
    """
    history = prepare_history(hist)
    return score_items(restored_catalog(db, history), history, as_of, cfg)


OUTLIER_METRICS = (("play_count", "play"), ("upvote_count", "like"), ("comment_count", "comment"))


def outlier_flags(df: DataFrame, sigma: float = 6.0, use_log: bool = True) -> DataFrame:
    """Population z-score per counter; the statistics are a one-row aggregate."""
    value = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c, _ in OUTLIER_METRICS}
    scaled = {c: log_count(v) if use_log else v for c, v in value.items()}
    stats = df.agg(
        *[F.avg(scaled[c]).alias(f"_{n}_mean") for c, n in OUTLIER_METRICS],
        *[F.stddev_pop(scaled[c]).alias(f"_{n}_std") for c, n in OUTLIER_METRICS],
    )
    out = df.crossJoin(F.broadcast(stats))
    for c, name in OUTLIER_METRICS:
        std = F.col(f"_{name}_std")
        z = F.when(std > 0, (scaled[c] - F.col(f"_{name}_mean")) / std)
        out = out.withColumn(f"{name}_zscore", z)
        out = out.withColumn(f"{name}_outlier", F.coalesce(F.col(f"{name}_zscore") >= sigma, F.lit(False)))
    reasons = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f"{name}_outlier"),
                    F.concat(
                        F.lit(f"{name} "),
                        F.format_number(value[c].cast("long"), 0),
                        F.lit(" / z="),
                        F.format_string("%.2f", F.col(f"{name}_zscore")),
                    ),
                )
                for c, name in OUTLIER_METRICS
            ]
        )
    )
    out = out.withColumn("outlier_reasons", F.array_join(reasons, " | "))
    return out.withColumn("is_outlier", F.col("outlier_reasons") != "").drop(*stats.columns)
