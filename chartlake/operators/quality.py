"""Comment storage, quality summary per item and its write-back."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartlake.functions.coerce import as_ts, clamp, is_blank, round_binary, strip
from chartlake.functions.comments import MENTIONS, classify, quality_bucket
from chartlake.functions.text import stable_comment_id
from chartlake.operators.catalog import dedupe_keep
from chartlake.operators.skew import salted_join

QUALITY_COLUMNS = (
    "adjusted_comment_count", "comment_quality_ratio", "analyzed_comment_count",
    "meaningful_count", "generic_count", "mention_only_count", "emoji_only_count",
    "comment_quality_summary", "comment_quality_checked_at",
)
LABEL_COLUMNS = {
    "quality_label": "string",
    "quality_weight": "double",
    "is_meaningful": "boolean",
    "is_generic": "boolean",
    "is_mention_only": "boolean",
    "is_emoji_only": "boolean",
    "analyzed_at": "timestamp_ntz",
}
# Weights are summed as whole ten-thousandths: the result does not depend on the
# order in which partitions arrive.
WEIGHT_SCALE = 10000.0
BUCKETS = ("meaningful", "generic", "mention_only", "emoji_only")


def comments_schema() -> T.StructType:
    text = ("comment_id", "song_id", "content", "user_handle", "user_display_name")
    return T.StructType(
        [T.StructField(c, T.StringType()) for c in text]
        + [T.StructField("created_at", T.TimestampNTZType()), T.StructField("user_mentions", MENTIONS)]
    )


def unseen_comments(stored: DataFrame, fetched: DataFrame, as_of: str) -> DataFrame:
    """Fetched comments that are not stored yet, without labels.

    Comments without an id get a stable one; blank ones are dropped; of equal
    ids within a batch the earliest is kept.
    """
    given = strip(F.coalesce(F.col("comment_id"), F.lit("")))
    handle = F.col("user_handle") if "user_handle" in fetched.columns else F.lit("")
    made = stable_comment_id(F.col("song_id"), F.col("created_at"), handle, F.col("content"))
    filled = fetched.where(strip(F.coalesce(F.col("content"), F.lit(""))) != "")
    named = filled.withColumn("comment_id", F.when(given != "", given).otherwise(made))
    first = [F.col("created_at").asc_nulls_last(), F.col("content").asc()]
    return (
        dedupe_keep(named, ["comment_id"], first)
        .join(stored.select("comment_id"), "comment_id", "left_anti")
        .withColumn("fetched_at", as_ts(as_of))
        .withColumns({c: F.lit(None).cast(t) for c, t in LABEL_COLUMNS.items()})
    )


def upsert_comments(stored: DataFrame, fetched: DataFrame, as_of: str) -> DataFrame:
    """Stored comments plus the unseen fetched ones; existing labels stay."""
    return stored.unionByName(unseen_comments(stored, fetched, as_of), allowMissingColumns=True)


def unanalyzed(comments: DataFrame, songs: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Comments without an analysis time; optionally of given songs, the oldest ids first."""
    pending = comments.where(is_blank("analyzed_at"))
    if songs is not None:
        pending = salted_join(pending, songs.select(F.col("id").alias("song_id")).distinct(), ["song_id"], "left_semi")
    return pending if limit is None else pending.orderBy("comment_id").limit(limit)


def mark_analyzed(pending: DataFrame, as_of: str, mentions: str | None = "user_mentions") -> DataFrame:
    """Classify pending comments and stamp them."""
    plain = pending.drop(*LABEL_COLUMNS)
    named = mentions if mentions in pending.columns else None
    bucket = quality_bucket("quality_label")
    return classify(plain, "content", named).withColumns(
        {**{f"is_{b}": bucket == b for b in BUCKETS}, "analyzed_at": as_ts(as_of)}
    )


def quality_summary(labelled: DataFrame, counts: DataFrame, empty_policy: str = "keep") -> DataFrame:
    """Quality per item of ``counts`` (id, comment_count) from labelled comments.

    The first aggregate, by (song, label), is combined map-side, so an item with
    very many comments reaches the second one as at most a dozen rows.
    """
    per_label = labelled.groupBy("song_id", "quality_label").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.round(F.col("quality_weight") * WEIGHT_SCALE).cast("long")).alias("_w")
    )
    bucket = quality_bucket("quality_label")
    entry = F.struct((-F.col("_n")).alias("n"), F.col("quality_label").alias("l"))
    per_song = per_label.groupBy(F.col("song_id").alias("id")).agg(
        F.sum("_n").alias("analyzed_comment_count"),
        *[F.sum(F.when(bucket == b, F.col("_n")).otherwise(0)).alias(f"{b}_count") for b in BUCKETS],
        (F.coalesce(F.sum("_w"), F.lit(0)) / F.lit(WEIGHT_SCALE)).alias("_sum"),
        F.sort_array(F.collect_list(entry)).alias("_labels"),
    )
    out = counts.select("id", F.col("comment_count").cast("double").alias("comment_count")).join(per_song, "id", "left")
    analyzed = F.coalesce(F.col("analyzed_comment_count"), F.lit(0))
    ratio = clamp(F.col("_sum") / analyzed, 0.0, 1.0)
    empty_ratio = F.lit(1.0)
    empty_adjusted = F.col("comment_count")
    if empty_policy == "zero":
        none = F.col("comment_count") <= 0
        empty_ratio = F.when(none, F.lit(1.0)).otherwise(F.lit(0.0))
        empty_adjusted = F.when(none, F.col("comment_count")).otherwise(F.lit(0.0))
    text = F.array_join(
        F.transform("_labels", lambda x: F.concat(x["l"], F.lit(":"), (-x["n"]).cast("string"))), ", "
    )
    has = analyzed > 0
    return out.select(
        "id",
        F.col("comment_count"),
        analyzed.cast("long").alias("analyzed_comment_count"),
        *[F.coalesce(F.col(f"{b}_count"), F.lit(0)).cast("long").alias(f"{b}_count") for b in BUCKETS],
        F.when(has, round_binary(F.col("_sum"), 4)).otherwise(0.0).alias("weighted_quality_sum"),
        F.when(has, round_binary(ratio, 4)).otherwise(empty_ratio).alias("comment_quality_ratio"),
        F.when(has, round_binary(F.col("comment_count") * ratio, 2)).otherwise(empty_adjusted).alias("adjusted_comment_count"),
        F.when(has, text)
        .otherwise(F.when(F.col("comment_count") <= 0, F.lit("no_comments")).otherwise(F.lit("no_analyzed_comments")))
        .alias("comment_quality_summary"),
    )


def fetch_needed(db: DataFrame, comments: DataFrame) -> DataFrame:
    """Items that have more comments than are stored."""
    stored = comments.groupBy(F.col("song_id").alias("id")).agg(F.count(F.lit(1)).alias("stored_count"))
    joined = db.join(stored, "id", "left").withColumn("stored_count", F.coalesce("stored_count", F.lit(0)))
    return joined.where((F.col("comment_count") > 0) & (F.col("stored_count") < F.col("comment_count")))


def quality_writeback(db: DataFrame, summary: DataFrame, as_of: str) -> DataFrame:
    """New quality values over the old ones; items outside the summary keep theirs."""
    fresh = summary.withColumn("comment_quality_checked_at", as_ts(as_of))
    fresh = fresh.select("id", *[F.col(c).alias(f"_q_{c}") for c in QUALITY_COLUMNS])
    out = db.join(fresh, "id", "left")
    merged = {
        c: F.coalesce(F.col(f"_q_{c}"), F.col(c)) if c in db.columns else F.col(f"_q_{c}") for c in QUALITY_COLUMNS
    }
    return out.withColumns(merged).drop(*[f"_q_{c}" for c in QUALITY_COLUMNS])
