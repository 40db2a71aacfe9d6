"""Play, like and comment events: counters, scores, likes, comments."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartlake.functions.coerce import strip
from chartlake.functions.scores import community_score
from chartlake.functions.text import contains_listed_term, plain_text
from chartlake.operators.charts import newest_order, ranked_top
from chartlake.operators.skew import salted_join
from chartlake.session import materialize

MIN_KEY_LENGTH = 6
MIN_BODY, MAX_BODY = 2, 500


def valid_key(c: str) -> Column:
    return F.col(c).isNotNull() & (F.length(strip(c)) >= MIN_KEY_LENGTH)


def valid_plays(events: DataFrame) -> DataFrame:
    """Play requests with a usable session; negative seconds count as 0."""
    seconds = F.greatest(F.coalesce(F.col("play_seconds").cast("long"), F.lit(0)), F.lit(0))
    return events.where(F.col("song_id").isNotNull() & valid_key("session_id")).withColumn("play_seconds", seconds)


def unique_plays(events: DataFrame) -> DataFrame:
    """One play per (song, session): the first by time."""
    w = Window.partitionBy("song_id", "session_id").orderBy("counted_at", "event_id")
    return valid_plays(events).withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def liked_pairs(toggles: DataFrame, key: str = "song_id") -> DataFrame:
    """(item, actor) pairs that are liked now: an odd number of toggles."""
    valid = toggles.where(F.col(key).isNotNull() & valid_key("actor_key"))
    counted = valid.groupBy(key, "actor_key").agg(F.count(F.lit(1)).alias("_n"))
    return counted.where(F.col("_n") % 2 == 1).select(key, "actor_key")


def song_counters(
    songs: DataFrame, plays: DataFrame, likes: DataFrame, comments: DataFrame, as_of: str
) -> DataFrame:
    """Counters and score of all songs at once.

    ``plays`` and ``likes`` are unique pairs; each input is aggregated per song,
    map-side first, before it meets the songs.
    """

    def per_song(df, name):
        return df.groupBy(F.col("song_id").alias("id")).agg(F.count(F.lit(1)).alias(name))

    visible = comments.where(F.col("status") == "visible")
    out = songs.drop("play_count", "like_count", "comment_count", "trend_score")
    for df, name in ((plays, "play_count"), (likes, "like_count"), (visible, "comment_count")):
        out = out.join(per_song(df, name), "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    score = community_score("play_count", "like_count", "comment_count", "created_at", as_of)
    return out.withColumn("trend_score", score)


def app_song_stats(play_events: DataFrame, likes: DataFrame, approximate: bool = False) -> DataFrame:
    """Counted plays, likes and distinct known listeners per song."""
    listeners = F.approx_count_distinct if approximate else F.count_distinct
    plays = (
        play_events.where(F.col("counted"))
        .groupBy("song_id")
        .agg(
            F.count(F.lit(1)).alias("app_play_count"),
            listeners(F.nullif(F.col("user_id"), F.lit(""))).alias("unique_listener_count"),
        )
    )
    liked = likes.groupBy("song_id").agg(F.count(F.lit(1)).alias("app_like_count"))
    names = ("app_play_count", "app_like_count", "unique_listener_count")
    return plays.join(liked, "song_id", "full").select(
        "song_id", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names]
    )


# Sketches of 2**12 places; estimates of few listeners are near exact, of many within 5 % (three sigma).
SKETCH_BITS = 12


def listener_sketches(play_events: DataFrame) -> DataFrame:
    """Distinct known listeners per song and day as mergeable sketches, from counted plays."""
    known = play_events.where(F.col("counted") & (F.coalesce("user_id", F.lit("")) != ""))
    day = F.to_date("counted_at").alias("day")
    return known.groupBy("song_id", day).agg(F.hll_sketch_agg("user_id", SKETCH_BITS).alias("sketch"))


def listeners_of(sketches: DataFrame) -> DataFrame:
    """Estimated distinct listeners per song over all days and batches of ``sketches``."""
    return sketches.groupBy("song_id").agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch", F.lit(False))).cast("long").alias("listener_count")
    )


def public_songs(songs: DataFrame) -> DataFrame:
    return songs.where((F.col("visibility") == "public") & (F.col("status") == "active"))


def songs_with_profile(songs: DataFrame, profiles: DataFrame) -> DataFrame:
    names = profiles.select(
        F.col("user_id").alias("uploader_user_id"),
        F.col("display_name").alias("profile_name"),
        F.col("avatar_url").alias("profile_avatar"),
    )
    return salted_join(songs, names, ["uploader_user_id"], "left")


def liked_flags(songs: DataFrame, likes: DataFrame, actor: str) -> DataFrame:
    """Songs with a flag whether ``actor`` likes them."""
    mine = likes.where(F.col("actor_key") == actor).select(F.col("song_id").alias("id")).distinct()
    out = songs.join(mine.withColumn("_liked", F.lit(True)), "id", "left")
    return out.withColumn("liked", F.coalesce("_liked", F.lit(False))).drop("_liked")


def comment_like_counts(comments: DataFrame, likes: DataFrame) -> DataFrame:
    counts = likes.groupBy(F.col("comment_id").alias("id")).agg(F.count(F.lit(1)).alias("like_count"))
    out = comments.drop("like_count").join(counts, "id", "left")
    return out.withColumn("like_count", F.coalesce("like_count", F.lit(0)))


TABS = ("trending", "new", "liked", "played")


def community_tabs(songs: DataFrame, limit: int = 300) -> DataFrame:
    """The four public lists with tab label and rank.

    Each list is a distributed top-k over ids and sort values, which are stored once;
    the winners are joined back to the songs.
    """
    shown = public_songs(songs)
    narrow = materialize(shown.select("id", "created_at", F.round("trend_score", 6).alias("trending"),
                                      F.col("like_count").alias("liked"), F.col("play_count").alias("played")))
    lists = []
    for tab in TABS:
        first = [] if tab == "new" else [F.col(tab).desc_nulls_last()]
        top = ranked_top(narrow, [*first, *newest_order()], limit)
        lists.append(top.select("id", F.lit(tab).alias("tab"), "rank"))
    return shown.join(reduce(DataFrame.union, lists), "id")


def latest_comments(comments: DataFrame, k: int = 50) -> DataFrame:
    """Newest ``k`` visible comments per song."""
    w = Window.partitionBy("song_id").orderBy(F.col("created_at").desc_nulls_last(), F.col("id").asc())
    shown = comments.where(F.col("status") == "visible").withColumn("position", F.row_number().over(w))
    return shown.where(F.col("position") <= k)


def admissible_comments(comments: DataFrame, songs: DataFrame, terms: Sequence[str] = ()) -> DataFrame:
    """Comment requests with the verdict: accepted, or the first reason against."""
    allowed = songs.select(F.col("id").alias("song_id"), F.col("comments_enabled").alias("_enabled"))
    body = F.col("_body")
    out = salted_join(comments, allowed, ["song_id"], "left").withColumn("_body", plain_text("body"))
    reason = (
        F.when(~F.coalesce(F.col("_enabled"), F.lit(False)), "comments disabled")
        .when(F.length(body) < MIN_BODY, "too short")
        .when(F.length(body) > MAX_BODY, "too long")
        .when(contains_listed_term(body, terms), "listed term")
        .otherwise("")
    )
    return out.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "").drop("_body", "_enabled")


def own_songs(songs: DataFrame, user_id: str) -> DataFrame:
    return songs.where(F.col("uploader_user_id") == user_id).orderBy(*newest_order())


def delete_cascade(parents: DataFrame, doomed: DataFrame, children: DataFrame, key: str, child_key: str):
    """Parents without the doomed ones, and children without their parents' rows.

    ``doomed`` has the key column; the owner test belongs to the caller.
    """
    gone = doomed.select(key).distinct()
    left = parents.join(gone, key, "left_anti")
    orphaned = gone.withColumnRenamed(key, child_key)
    return left, salted_join(children, orphaned, [child_key], "left_anti")


def soft_delete(songs: DataFrame, doomed: DataFrame) -> DataFrame:
    """Doomed (id, uploader) pairs become deleted and private; others are untouched."""
    marks = doomed.select("id", "uploader_user_id").distinct().withColumn("_gone", F.lit(True))
    out = songs.join(marks, ["id", "uploader_user_id"], "left")
    gone = F.coalesce(F.col("_gone"), F.lit(False))
    return out.withColumns(
        {
            "status": F.when(gone, F.lit("deleted")).otherwise(F.col("status")),
            "visibility": F.when(gone, F.lit("private")).otherwise(F.col("visibility")),
        }
    ).drop("_gone")
