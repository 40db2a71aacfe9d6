"""Structured Streaming jobs over engagement events, snapshots and comments.

Logs are append-only: every micro-batch writes its own ``batch=<id>`` folder in
overwrite mode, so a repeated batch replaces itself and no batch rewrites
earlier data. What a stream must remember (seen keys, likes, totals) is a table in
hash buckets beside the log, not state in memory: a batch reads and changes the
buckets of its own songs only, and the table knows the last batch of each stream. A
batch writes such tables in an order that lets it be repeated after any failure.
Event times are ``timestamp`` at the stream edge (watermarks need it) and without
zone everywhere else.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from chartlake.functions.coerce import strip
from chartlake.functions.scores import community_score
from chartlake.operators.catalog import dedupe_keep
from chartlake.operators.engagement import valid_key, valid_plays
from chartlake.operators.quality import mark_analyzed
from chartlake.plans.upkeep import history_table
from chartlake.session import materialize, scratch
from chartlake.sources.parts import KeyedTable
from chartlake.sources.tables import GRACE, read_snapshot, replace_snapshot

BATCH = "batch"
# Folder of rewritten batches; readers of the log skip names with an underscore.
BASE = "_base"


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, name: str | None = None) -> DataFrame:
    """Stream of the landed parquet files of a folder, or of the file or folder ``name`` in it.

    The name is given as a pattern, since a plain path of a stream must be a folder.
    """
    return spark.readStream.schema(schema).parquet(folder if name is None else f"{folder}/{{{name}}}")


def write_batch(df: DataFrame, folder: str, batch_id: int) -> None:
    """Write one micro-batch; repeating a batch id replaces its rows."""
    df.write.mode("overwrite").parquet(f"{folder}/{BATCH}={batch_id}")


def read_batches(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """All batches written so far (also when there are none yet): rewritten ones and those after."""
    full = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
    tail = spark.read.schema(full).option("basePath", folder).parquet(folder)
    base = read_snapshot(spark, f"{folder}/{BASE}", full)
    upto = base.agg(F.max(BATCH)).first()[0]
    return tail if upto is None else base.unionByName(tail.where(F.col(BATCH) > upto))


def rewrite_batches(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    shrink: Callable[[DataFrame], DataFrame],
    keep: int = 1,
    ordered: bool = False,
) -> int | None:
    """Fold the batches of a log into one table, so that readers list few files.

    ``shrink`` turns the rows of several batches into fewer ones of the same meaning
    (with ``ordered`` it also gets their batch).
    The folded table is published whole before old batch folders are removed, and
    readers skip folders that it covers, so a crash in between loses or doubles
    nothing. The newest ``keep`` batches stay: the stream may repeat the last one.
    """
    rows = read_batches(spark, folder, schema)
    newest = rows.agg(F.max(BATCH)).first()[0]
    if newest is None or newest - keep < 0:
        return None
    upto = newest - keep
    covered = rows.where(F.col(BATCH) <= upto)
    folded = shrink(covered if ordered else covered.select(*schema.names)).select(*schema.names)
    replace_snapshot(folded.withColumn(BATCH, F.lit(upto).cast("long")), f"{folder}/{BASE}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for found in fs.globStatus(path(f"{folder}/{BATCH}=*")) or []:
        if int(found.getPath().getName().split("=")[1]) <= upto:
            fs.delete(found.getPath(), True)
    return upto


def run_available(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Process everything that has landed, then stop."""
    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def ensure_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


# Seen keys --------------------------------------------------------------------
# Hash buckets of the tables beside the logs, unless a job names another number.
BUCKETS = 64
PAIR = ["song_id", "session_id"]


def key_table(spark: SparkSession, path: str, keys: Sequence[str], by: Sequence[str] = (), buckets: int = BUCKETS) -> KeyedTable:
    """Table of text keys that a stream has seen."""
    schema = T.StructType([T.StructField(k, T.StringType()) for k in keys])
    return KeyedTable(spark, path, schema, keys, buckets, by)


def unseen(batch: DataFrame, seen: KeyedTable) -> DataFrame:
    """One row for each key of the batch that is not in the table, and only its buckets read.

    ``batch`` is stored; of its rows with one key the first by time, then by hash, counts.
    """
    order = [F.col("counted_at").asc()] if "counted_at" in batch.columns else []
    one = dedupe_keep(batch, seen.keys, [*order, F.xxhash64(*batch.columns).asc()])
    return one.join(seen.read(seen.touched(batch)), seen.keys, "left_anti")


# Plays ------------------------------------------------------------------------
def unique_play_stream(plays: DataFrame, qualifies: Column | None = None, bounded_by: str = "7 days") -> DataFrame:
    """One play per (song, session) within the watermark ``bounded_by``; a repeat after it counts again."""
    valid = valid_plays(plays if qualifies is None else plays.where(qualifies))
    timed = valid.withColumn("counted_at", F.col("counted_at").cast("timestamp"))
    return timed.withWatermark("counted_at", bounded_by).dropDuplicatesWithinWatermark(PAIR)


def seen_plays(spark: SparkSession, folder: str, buckets: int = BUCKETS) -> KeyedTable:
    return key_table(spark, f"{folder}/_seen", PAIR, ["song_id"], buckets)


def play_sink(
    plays: DataFrame, folder: str, checkpoint: str, qualifies=None, bounded_by=None, buckets: int = BUCKETS
) -> StreamingQuery:
    """Append unique plays to a parquet table.

    Exact by default: pairs ever counted are a table in buckets of songs, of which a
    batch reads those of its songs. ``bounded_by`` (such as "7 days") keeps pairs in
    state, within the watermark only.
    """
    if bounded_by is None:
        seen = seen_plays(plays.sparkSession, folder, buckets)

        def write(batch: DataFrame, batch_id: int) -> None:
            if not seen.applied(checkpoint, batch_id):
                with scratch(batch.sparkSession):
                    valid = materialize(valid_plays(batch if qualifies is None else batch.where(qualifies)))
                    fresh = materialize(unseen(valid, seen))
                    write_batch(fresh, folder, batch_id)
                    seen.append(fresh, checkpoint, batch_id)

        return run_available(plays, checkpoint, write)
    query = (
        unique_play_stream(plays, qualifies, bounded_by)
        .writeStream.format("parquet")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


# Likes ------------------------------------------------------------------------
TOGGLE_LOG = T.StructType(
    [
        T.StructField("song_id", T.StringType()),
        T.StructField("actor_key", T.StringType()),
        T.StructField("toggles", T.LongType()),
    ]
)


def toggle_batch(batch: DataFrame) -> DataFrame:
    valid = batch.where(F.col("song_id").isNotNull() & valid_key("actor_key"))
    return valid.groupBy("song_id", "actor_key").agg(F.count(F.lit(1)).alias("toggles"))


def like_sink(toggles: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append the toggle counts of each batch; parity is taken when reading."""
    ensure_folder(toggles.sparkSession, folder)
    return run_available(toggles, checkpoint, lambda df, i: write_batch(toggle_batch(df), folder, i))


def rewrite_toggles(spark: SparkSession, folder: str) -> int | None:
    """Fold the toggle log to one row per (song, actor)."""
    pair = ["song_id", "actor_key"]
    return rewrite_batches(spark, folder, TOGGLE_LOG, lambda df: df.groupBy(*pair).agg(F.sum("toggles").alias("toggles")))


def liked_now(spark: SparkSession, folder: str) -> DataFrame:
    """(song, actor) pairs that are liked: an odd number of toggles over all batches."""
    total = F.sum("toggles")
    log = read_batches(spark, folder, TOGGLE_LOG).groupBy("song_id", "actor_key").agg(total.alias("toggles"))
    return log.where(F.col("toggles") % 2 == 1).select("song_id", "actor_key")


# Counters ---------------------------------------------------------------------
class Counters:
    """Totals of plays and likes by song, with what is needed to keep them."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        def total(name: str) -> KeyedTable:
            fields = [T.StructField("song_id", T.StringType()), T.StructField(name, T.LongType())]
            return KeyedTable(spark, f"{folder}/{name}", T.StructType(fields), ["song_id"], buckets)

        self.seen = seen_plays(spark, folder, buckets)
        self.toggles = KeyedTable(spark, f"{folder}/_toggles", TOGGLE_LOG, ["song_id", "actor_key"], buckets, ["song_id"])
        self.plays, self.likes = total("play_count"), total("like_count")

    def add(self, table: KeyedTable, changes: DataFrame, stream: str, batch_id: int) -> None:
        """Add ``changes`` (by song) to the totals of their songs."""
        name = table.schema.names[1]

        def summed(old: DataFrame, new: DataFrame) -> DataFrame:
            return old.unionByName(new).groupBy("song_id").agg(F.sum(name).alias(name))

        table.merge(changes, summed, stream, batch_id)

    def count_plays(self, batch: DataFrame, stream: str, batch_id: int) -> None:
        """Count the new (song, session) pairs of a batch. The seen pairs, that tell new
        ones, are written last: until then the batch can be repeated."""
        if not self.seen.applied(stream, batch_id):
            with scratch(batch.sparkSession):
                fresh = materialize(unseen(materialize(valid_plays(batch)), self.seen).select(*PAIR))
                self.add(self.plays, fresh.groupBy("song_id").agg(F.count(F.lit(1)).alias("play_count")), stream, batch_id)
                self.seen.append(fresh, stream, batch_id)

    def count_likes(self, batch: DataFrame, stream: str, batch_id: int) -> None:
        """Turn the likes that a batch toggles an odd number of times; the toggles are written last."""
        if not self.toggles.applied(stream, batch_id):
            with scratch(batch.sparkSession):
                turned = materialize(toggle_batch(batch).where(F.col("toggles") % 2 == 1))
                pair = ["song_id", "actor_key"]
                before = self.toggles.read(self.toggles.touched(turned)).groupBy(*pair).agg(F.sum("toggles").alias("_before"))
                step = F.when(F.coalesce("_before", F.lit(0)) % 2 == 1, -1).otherwise(1)
                changes = turned.join(before, pair, "left").groupBy("song_id").agg(F.sum(step).alias("like_count"))
                self.add(self.likes, changes, stream, batch_id)
                self.toggles.append(turned, stream, batch_id)


def counter_sinks(plays: DataFrame, toggles: DataFrame, folder: str, checkpoint: str, buckets: int = BUCKETS) -> None:
    """Keep the play and like totals of all songs; a batch reads and writes the buckets of its songs."""
    counters = Counters(plays.sparkSession, folder, buckets)
    run_available(plays, f"{checkpoint}/plays", lambda df, i: counters.count_plays(df, f"{checkpoint}/plays", i))
    run_available(toggles, f"{checkpoint}/likes", lambda df, i: counters.count_likes(df, f"{checkpoint}/likes", i))


def rewrite_counters(spark: SparkSession, folder: str, over: int = 8, grace: float = GRACE) -> None:
    """Upkeep: buckets that were appended to often become one folder; old versions go."""
    counters = Counters(spark, folder)
    counters.seen.fold(over=over)
    total = F.sum("toggles").alias("toggles")
    counters.toggles.fold(
        lambda df: df.groupBy("song_id", "actor_key").agg(total).where(F.col("toggles") % 2 == 1), over=over
    )
    for table in (counters.seen, counters.toggles, counters.plays, counters.likes):
        table.clean(grace)


def current_counters(songs: DataFrame, comments: DataFrame, folder: str, as_of: str) -> DataFrame:
    """Counters and score of all songs from their totals."""
    counters = Counters(songs.sparkSession, folder)
    visible = comments.where(F.col("status") == "visible").groupBy("song_id")
    shown = visible.agg(F.count(F.lit(1)).alias("comment_count"))
    parts = ((counters.plays.read(), "play_count"), (counters.likes.read(), "like_count"), (shown, "comment_count"))
    out = songs.withColumn("song_id", F.col("id"))
    for counts, name in parts:
        out = out.join(counts, "song_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    score = community_score("play_count", "like_count", "comment_count", "created_at", as_of)
    return out.withColumn("trend_score", score).drop("song_id")


# Snapshots --------------------------------------------------------------------
def history_sink(snapshots: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append landed snapshots to a history table in days (see ``compact_days``)."""
    table = history_table(snapshots.sparkSession, folder, snapshots.schema)
    return run_available(snapshots, checkpoint, lambda df, i: table.append(df, checkpoint, i))


# Comments ---------------------------------------------------------------------
def comment_sink(
    comments: DataFrame, folder: str, checkpoint: str, as_of: str, label_columns: Sequence[str] = (), buckets: int = BUCKETS
) -> StreamingQuery:
    """Classify newly landed comments once.

    Blank comments and ids classified before, which are a table in buckets, are left
    out; the checkpoint takes the place of a "not yet analysed" column.
    """
    spark = comments.sparkSession
    ensure_folder(spark, folder)
    seen = key_table(spark, f"{folder}/_seen", ["comment_id"], buckets=buckets)

    def classify_batch(batch: DataFrame, batch_id: int) -> None:
        if not seen.applied(checkpoint, batch_id):
            with scratch(spark):
                filled = batch.where(strip(F.coalesce(F.col("content"), F.lit(""))) != "")
                fresh = materialize(unseen(materialize(filled), seen))
                labelled = mark_analyzed(fresh, as_of)
                write_batch(labelled.select(*label_columns) if label_columns else labelled, folder, batch_id)
                seen.append(fresh, checkpoint, batch_id)

    return run_available(comments, checkpoint, classify_batch)
