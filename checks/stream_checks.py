"""Streaming jobs, run over the landed tables until nothing is left."""
from __future__ import annotations

from pyspark.sql import functions as F

from chartlake.functions.scores import play_qualifies
from chartlake.plans.upkeep import compact_days, history_table
from chartlake.sources.driver import AS_OF
from chartlake.streaming import jobs
from checks.ingest_checks import work_folder
from checks.registry import check


# Few, as the tables are small here.
BUCKETS = 8


def event_stream(d):
    return jobs.file_stream(d.spark, d.folder, d.raw("events").schema, "events.parquet")


def in_batches(d, run, upkeep) -> None:
    """Land the events in three folders, one batch each; ``upkeep`` runs before the last one."""
    landed = work_folder(d, "landed")
    events = d.raw("events")
    for k in range(3):
        events.where(F.col("event_id") % 3 == k).write.parquet(f"{landed}/{k}")
        if k == 2:
            upkeep()
        run(d.spark.readStream.schema(events.schema).parquet(f"{landed}/*"))


def part_count(d):
    return F.broadcast(d.raw("part").agg(F.count(F.lit(1)).alias("_n")))


def with_song(d, stream):
    song = (F.floor("value") * 7 + F.col("user_id")) % F.col("_n")
    return stream.crossJoin(part_count(d)).withColumn("song_id", song.cast("string")).drop("_n")


def play_stream(d, events=None):
    events = event_stream(d) if events is None else events
    views = with_song(d, events.where(F.col("event_type") == "view"))
    return views.select(
        "song_id",
        F.concat(F.lit("ses-"), F.col("user_id").cast("string")).alias("session_id"),
        F.floor("value").cast("long").alias("play_seconds"),
        F.col("ts").alias("counted_at"),
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


def toggle_stream(d, events=None):
    events = event_stream(d) if events is None else events
    clicks = with_song(d, events.where(F.col("event_type") == "click"))
    return clicks.select("song_id", F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("actor_key"))


@check(
    "stream_play_dedupe",
    """SELECT DISTINCT song_id, session_id FROM v_play_events
       WHERE len(session_id) >= 6 AND value >= 10 AND value * k / 100 / value >= 0.30""",
)
def stream_play_dedupe(d):
    folder = work_folder(d, "plays")
    qualifies = play_qualifies("value", F.col("value") * F.col("k") / 100)
    jobs.play_sink(play_stream(d), f"{folder}/table", f"{folder}/checkpoint", qualifies, buckets=BUCKETS)
    return d.spark.read.parquet(f"{folder}/table").select("song_id", "session_id")


@check("stream_play_batches", "SELECT song_id, session_id, counted_at FROM v_first_plays")
def stream_play_batches(d):
    """Unique plays over several batches, each a run of its own."""
    folder = work_folder(d, "plays")
    in_batches(
        d,
        lambda events: jobs.play_sink(play_stream(d, events), f"{folder}/table", f"{folder}/checkpoint", buckets=BUCKETS),
        lambda: jobs.seen_plays(d.spark, f"{folder}/table").fold(over=1),
    )
    return d.spark.read.parquet(f"{folder}/table").select("song_id", "session_id", "counted_at")


@check("stream_like_toggle", "SELECT song_id, count(*) AS like_count FROM v_likes GROUP BY 1")
def stream_like_toggle(d):
    folder = work_folder(d, "likes")
    in_batches(
        d,
        lambda events: jobs.like_sink(toggle_stream(d, events), f"{folder}/log", f"{folder}/checkpoint"),
        lambda: jobs.rewrite_toggles(d.spark, f"{folder}/log"),
    )
    return jobs.liked_now(d.spark, f"{folder}/log").groupBy("song_id").agg(F.count(F.lit(1)).alias("like_count"))


@check("stream_song_counters", "SELECT id, play_count, like_count, comment_count, trend_score FROM v_counters")
def stream_song_counters(d):
    folder = work_folder(d, "counters")
    in_batches(
        d,
        lambda events: jobs.counter_sinks(
            play_stream(d, events).drop("value", "k"), toggle_stream(d, events), f"{folder}/log", f"{folder}/checkpoint", BUCKETS
        ),
        lambda: jobs.rewrite_counters(d.spark, f"{folder}/log", over=1),
    )
    out = jobs.current_counters(d.app_songs(), d.app_comments(), f"{folder}/log", AS_OF)
    return out.select("id", "play_count", "like_count", "comment_count", "trend_score")


@check(
    "stream_history",
    """SELECT id, checked_at, play_count FROM v_history WHERE checked_at >= TIMESTAMP '2024-01-24'
       UNION ALL SELECT id, checked_at, play_count FROM (SELECT * FROM v_history WHERE checked_at < TIMESTAMP '2024-01-24'
         QUALIFY row_number() OVER (PARTITION BY id, checked_at::DATE ORDER BY checked_at DESC, play_count + upvote_count + comment_count DESC) = 1)""",
)
def stream_history(d):
    """Snapshots land in two batches; days are compacted after each."""
    folder = work_folder(d, "history")
    history = d.song_history()
    table = history_table(d.spark, f"{folder}/table", history.schema)
    for k in range(2):
        history.where(F.pmod(F.xxhash64("id", "checked_at", "play_count"), F.lit(2)) == k).write.parquet(f"{folder}/landed/{k}")
        stream = d.spark.readStream.schema(history.schema).parquet(f"{folder}/landed/*")
        jobs.history_sink(stream, f"{folder}/table", f"{folder}/checkpoint")
        compact_days(table, AS_OF)
    return table.read().select("id", "checked_at", "play_count")


@check(
    "stream_comment_quality",
    "SELECT comment_id, quality_label, quality_weight FROM v_comments WHERE part = 'chat' AND trim(content, ' \t\n\r') <> ''",
)
def stream_comment_quality(d):
    folder = work_folder(d, "comments")
    turns = jobs.file_stream(d.spark, d.folder, d.raw("conversations").schema, "conversations.parquet")
    comments = turns.select(
        F.concat(F.lit("c-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("comment_id"),
        F.col("text").alias("content"),
    )
    columns = ("comment_id", "quality_label", "quality_weight")
    jobs.comment_sink(comments, f"{folder}/log", f"{folder}/checkpoint", AS_OF, columns, BUCKETS)
    schema = "comment_id string, quality_label string, quality_weight double"
    return d.spark.read.schema(schema).parquet(f"{folder}/log").select(*columns)
