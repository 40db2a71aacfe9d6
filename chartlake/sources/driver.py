"""Mapping of the given star-schema tables onto the chart domain.

Each function returns one domain table as a lazy DataFrame over whole given
tables. Rules are stated in FIXTURES.md; ids grow with the tables, so no domain
key collects a fixed share of the rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartlake.functions.comments import MENTIONS
from chartlake.operators.ordinal import running_totals
from chartlake.session import materialize, prepare_session

AS_OF = "2024-01-31 00:00:00"
FIRST_DAY = "2023-12-31"
CHART_SIZE = 200
ITEM_PREFIX = "https://tracks.example.com/song/"


class Domain:
    """Domain tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare_session(spark)
        self.folder = folder
        self._stored: dict[str, DataFrame] = {}

    def stored(self, name: str) -> DataFrame:
        """Domain table ``name`` written once, as a job over stored tables reads it."""
        if name not in self._stored:
            self._stored[name] = materialize(getattr(self, name)())
        return self._stored[name]

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _with_count(self, df: DataFrame, table: str, name: str = "_n") -> DataFrame:
        """Attach the row count of a table: a one-row frame."""
        return df.crossJoin(F.broadcast(self.raw(table).agg(F.count(F.lit(1)).alias(name))))

    # tracker side -----------------------------------------------------------
    def item_events(self) -> DataFrame:
        """Events with their item: one item per user and two-day period."""
        period = F.floor(F.datediff(F.to_date("ts"), F.lit(FIRST_DAY).cast("date")) / 2).cast("int")
        created = F.lit(f"{FIRST_DAY} 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
            days=F.col("bk") * 2, hours=(F.col("user_id") % 24).cast("int")
        )
        return (
            self.raw("events")
            .withColumn("bk", period)
            .select(
                "event_id",
                "user_id",
                "ts",
                "event_type",
                F.concat(F.col("user_id").cast("string"), F.lit("-"), F.col("bk").cast("string")).alias("id"),
                created.alias("created_at"),
            )
        )

    def song_history(self) -> DataFrame:
        """Cumulative counters after every event of an item."""
        kind = F.col("event_type")
        counted = running_totals(
            self.item_events().withColumnRenamed("ts", "checked_at"),
            ["id"],
            F.date_trunc("minute", "checked_at"),
            [F.col("checked_at"), F.col("event_id")],
            {
                "play_count": (kind == "view").cast("long"),
                "upvote_count": (kind == "click").cast("long"),
                "comment_count": (kind == "purchase").cast("long"),
                "flag_count": (kind == "error").cast("long"),
            },
        )
        return counted.select(
            "checked_at", "id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("handle"), "created_at",
            "play_count", "upvote_count", "comment_count", "flag_count",
        )

    def bare_songs(self) -> DataFrame:
        """Last counters per item: plain conditional counts, combined map-side."""
        kind = F.col("event_type")
        return (
            self.item_events()
            .groupBy("id", "user_id", "created_at")
            .agg(
                F.min("ts").alias("first_seen_at"),
                F.max("ts").alias("last_checked_at"),
                F.count_if(kind == "view").alias("play_count"),
                F.count_if(kind == "click").alias("upvote_count"),
                F.count_if(kind == "purchase").alias("comment_count"),
                F.count_if(kind == "error").alias("flag_count"),
                F.max(F.when(kind == "error", F.col("ts"))).alias("_last_error"),
            )
        )

    def songs(self, gaps: bool = False) -> DataFrame:
        """Item catalogue. ``gaps``: items whose last event is an error lost created_at."""
        parts = self.raw("part").select(
            F.col("p_partkey").alias("_part"), "p_name", "p_brand", "p_type", F.col("p_size").alias("_size")
        )
        base = self._with_count(self.bare_songs(), "part").withColumn("_part", F.col("user_id") % F.col("_n"))
        lost = F.col("_last_error") == F.col("last_checked_at")
        created = F.when(F.coalesce(lost, F.lit(False)), F.lit(None)).otherwise(F.col("created_at")) if gaps else F.col("created_at")
        user = F.col("user_id").cast("string")
        audio = F.concat(F.lit("https://cdn.example.com/a/"), "id", F.lit(".mp3"))
        return base.join(parts, "_part", "left").select(
            "id",
            F.col("p_name").alias("title"),
            F.concat(F.lit("u"), user).alias("handle"),
            F.when(F.col("comment_count") > 0, F.concat(F.lit("Creator "), user)).alias("display_name"),
            user.alias("user_id"),
            created.alias("created_at"),
            "first_seen_at",
            "last_checked_at",
            "play_count",
            "upvote_count",
            "comment_count",
            "flag_count",
            (F.col("flag_count") > F.col("upvote_count") + 1).alias("is_contest_clip"),
            F.when(F.col("comment_count") >= 4, F.lit("c-1")).otherwise(F.lit("")).alias("contest_ids"),
            F.when(F.col("flag_count") >= 4, F.lit("remix_contest")).alias("download_disabled_reason"),
            F.concat("p_brand", F.lit(", "), "p_type").alias("display_tags"),
            (F.col("_size") * 6.0).alias("duration"),
            F.concat(F.lit(ITEM_PREFIX), "id").alias("song_url"),
            F.when(F.col("play_count") > 0, audio).otherwise(F.lit("")).alias("audio_url"),
            F.when(F.col("upvote_count") >= 2, F.col("comment_count") * 0.5).alias("adjusted_comment_count"),
            F.when(F.col("flag_count") >= 5, F.lit("private"))
            .when(F.col("flag_count") == 0, F.lit(""))
            .otherwise(F.lit("active"))
            .alias("status"),
            (F.col("flag_count") * 3).alias("fetch_fail_count"),
            F.when(
                F.col("play_count") == 1, F.col("last_checked_at") + F.make_dt_interval(days=F.lit(2))
            ).alias("next_check_at"),
        )

    def ranked_songs(self) -> DataFrame:
        """Catalogue with an earlier chart: the top plays among items with a like."""
        from chartlake.operators.charts import ranked_top

        songs = self.songs()
        liked = songs.where(F.col("upvote_count") > 0).select("id", "play_count")
        order = [F.col("play_count").desc(), F.col("id").asc()]
        previous = ranked_top(liked, order, CHART_SIZE, "current_rank").select("id", "current_rank")
        return songs.join(F.broadcast(previous), "id", "left")

    def rank_history(self) -> DataFrame:
        """Hourly captures: the top items by score of the items seen in that hour."""
        from pyspark.sql import Window

        per_hour = (
            self.song_history()
            .groupBy("id", F.date_trunc("hour", "checked_at").cast("timestamp_ntz").alias("captured_at"))
            .agg(*[F.max(c).alias(c) for c in ("play_count", "upvote_count", "comment_count")])
        )
        base = (
            F.log1p("play_count") + F.log1p("upvote_count") * 3.0 + F.log1p("comment_count") * 4.0
        )
        scored = per_hour.withColumn("trend_score", F.round(base, 6))
        w = Window.partitionBy("captured_at").orderBy(F.col("trend_score").desc(), F.col("id").asc())
        top = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= CHART_SIZE)
        return top.select(
            "captured_at", "id", F.col("rank").cast("long").alias("rank"), "trend_score",
            F.col("trend_score").alias("base_score"), F.lit(0.0).alias("growth_score"),
            F.lit(0.0).alias("freshness_score"), "play_count", "upvote_count", "comment_count",
            F.col("comment_count").cast("double").alias("adjusted_comment_count"),
        )

    # comments ---------------------------------------------------------------
    def _comment_song(self, df: DataFrame, number: Column) -> DataFrame:
        """Attach song_id: spread a row number over the items."""
        out = self._with_count(df, "customer", "_c").withColumn("_k", number)
        users = F.greatest(F.floor(F.col("_c") / 10), F.lit(1))
        song = F.concat((F.col("_k") % users).cast("string"), F.lit("-"), (F.col("_k") % 16).cast("string"))
        created = F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(mins=F.col("_k").cast("int"))
        return out.withColumns({"song_id": song, "created_at": created})

    def chat_comments(self) -> DataFrame:
        """Every conversation turn as one comment."""
        df = self._comment_song(self.raw("conversations"), F.col("conv_id"))
        key = F.concat(F.lit("c-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
        return self._comments(df, key, F.col("text"), F.col("role"))

    def line_comments(self) -> DataFrame:
        """Every line of every document as one comment."""
        df = self._comment_song(self.raw("documents"), F.col("doc_id"))
        df = df.select("*", F.posexplode(F.split("text", "\n")).alias("_pos", "_line"))
        key = F.concat(F.lit("d-"), F.col("doc_id").cast("string"), F.lit("-"), F.col("_pos").cast("string"))
        return self._comments(df, key, F.col("_line"), F.col("source"))

    def part_comments(self) -> DataFrame:
        """One short comment per part, of a kind chosen by its size."""
        size, name = F.col("p_size"), F.col("p_name")
        content = (
            F.when(size <= 5, name)
            .when(size <= 10, F.col("p_type"))
            .when(size <= 15, F.concat(F.lit("love "), name))
            .when(size <= 20, F.concat(F.lit("love the chorus of "), name))
            .when(size <= 25, F.concat(F.lit("i really love this "), name))
            .when(size <= 30, F.lit("🔥🔥🔥"))
            .when(size <= 35, F.lit("hahahaha"))
            .when(size <= 40, F.concat(F.lit("@"), "p_brand"))
            .when(size <= 43, F.lit("nice"))
            .when(size <= 46, F.concat(F.lit("https://a.example/"), F.col("p_partkey").cast("string")))
            .otherwise(F.concat(F.lit("what is this "), name))
        )
        mentions = F.array(F.struct(F.lower("p_brand").alias("handle"), F.col("p_brand").alias("display_name")))
        df = self._comment_song(self.raw("part"), F.col("p_partkey"))
        key = F.concat(F.lit("p-"), F.col("p_partkey").cast("string"))
        return self._comments(df, key, content, F.lit("parts"), mentions)

    @staticmethod
    def _comments(df: DataFrame, key: Column, content: Column, handle: Column, mentions: Column | None = None):
        named = F.lit(None) if mentions is None else mentions
        return df.select(
            key.alias("comment_id"),
            "song_id",
            content.alias("content"),
            handle.alias("user_handle"),
            "created_at",
            named.cast(MENTIONS).alias("user_mentions"),
        )

    def comments(self) -> DataFrame:
        return self.chat_comments().unionByName(self.line_comments()).unionByName(self.part_comments())

    # community side ---------------------------------------------------------
    def app_songs(self) -> DataFrame:
        """Uploads: one per part, uploaded by a supplier."""
        size = F.col("p_size")
        return self._with_count(self.raw("part"), "supplier").select(
            F.col("p_partkey").cast("string").alias("id"),
            F.concat(F.lit("user"), (F.col("p_partkey") % F.col("_n")).cast("string")).alias("uploader_user_id"),
            F.col("p_name").alias("title"),
            F.when(size > 10, F.concat(F.lit("Artist "), "p_brand")).otherwise(F.lit("")).alias("artist_name"),
            F.concat("p_type", F.lit(" from "), "p_brand").alias("description"),
            F.concat("p_brand", F.lit(", "), "p_type").alias("style_tags"),
            F.when(size > 45, "private").otherwise("public").alias("visibility"),
            F.when(size.between(40, 45), "deleted").otherwise("active").alias("status"),
            (size >= 3).alias("comments_enabled"),
            (F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(hours=size * 5)).alias("created_at"),
        )

    def profiles(self) -> DataFrame:
        key = F.col("s_suppkey").cast("string")
        return self.raw("supplier").select(
            F.concat(F.lit("user"), key).alias("user_id"),
            F.col("s_name").alias("display_name"),
            F.concat(F.lit("https://cdn.example.com/p/"), key).alias("avatar_url"),
        )

    def _event_song(self, kind: str) -> DataFrame:
        df = self._with_count(self.raw("events").where(F.col("event_type") == kind), "part")
        number = (F.floor("value") * 7 + F.col("user_id")) % F.col("_n")
        return df.withColumn("song_id", number.cast("string"))

    def play_events(self) -> DataFrame:
        """View events as play requests; a session is a user."""
        return self._event_song("view").select(
            "event_id",
            "song_id",
            F.concat(F.lit("ses-"), F.col("user_id").cast("string")).alias("session_id"),
            F.when(F.col("user_id") > 2, F.concat(F.lit("user"), F.col("user_id").cast("string"))).alias("user_id"),
            F.floor("value").cast("long").alias("play_seconds"),
            F.col("ts").alias("counted_at"),
            (F.col("value") >= 10.0).alias("counted"),
            "value",
            F.get_json_object("props", "$.k").cast("double").alias("k"),
        )

    def like_toggles(self) -> DataFrame:
        return self._event_song("click").select(
            "event_id",
            "song_id",
            F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("actor_key"),
            F.col("ts").alias("toggled_at"),
        )

    def app_comments(self) -> DataFrame:
        """Conversation turns as comments on uploads; system turns are hidden."""
        df = self._with_count(self.raw("conversations"), "part")
        return df.select(
            F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"),
            ((F.col("conv_id") * 3 + F.col("turn") % 2) % F.col("_n")).cast("string").alias("song_id"),
            F.col("role").alias("user_id"),
            F.col("text").alias("body"),
            F.when(F.col("role") == "assistant", "hidden").otherwise("visible").alias("status"),
            (
                F.lit(AS_OF).cast("timestamp_ntz")
                - F.make_dt_interval(hours=F.col("conv_id").cast("int"), mins=F.col("turn").cast("int"))
            ).alias("created_at"),
        )

    def playlists(self) -> DataFrame:
        """Orders as playlists."""
        state = F.col("o_orderstatus")
        return self.raw("orders").select(
            F.col("o_orderkey").cast("string").alias("id"),
            F.concat(F.lit("user"), F.col("o_custkey").cast("string")).alias("owner_user_id"),
            F.col("o_orderpriority").alias("name"),
            F.when(state == "P", "private").otherwise("public").alias("visibility"),
            F.when(state == "F", "deleted").otherwise("active").alias("status"),
            F.col("o_orderdate").alias("updated_at"),
        )

    def playlist_items(self) -> DataFrame:
        """Order lines as playlist rows; (playlist, song) may repeat."""
        return self.raw("lineitem").select(
            F.col("l_orderkey").cast("string").alias("playlist_id"),
            F.col("l_partkey").cast("string").alias("song_id"),
            F.col("l_linenumber").alias("position"),
            F.col("l_shipdate").alias("added_at"),
            "l_suppkey",
            "l_extendedprice",
        )

    def unique_playlist_items(self) -> DataFrame:
        from chartlake.operators.playlists import unique_items

        return unique_items(self.playlist_items(), "l_suppkey", "l_extendedprice")

    def item_references(self) -> DataFrame:
        """Playlist rows that point at catalogue items, for the tier rules."""
        line = self.raw("lineitem")
        song = F.concat(F.col("l_suppkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
        return line.select(song.alias("song_id"))

    def queue(self) -> DataFrame:
        """Orders as item requests with good and bad links."""
        digest = F.md5(F.col("o_custkey").cast("string"))
        parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
        uuid = F.concat_ws("-", *parts)
        kind = F.col("o_orderpriority")
        code = F.col("o_orderkey").cast("string")
        url = (
            F.when(kind == "1-URGENT", F.concat(F.lit(ITEM_PREFIX), uuid))
            .when(kind == "2-HIGH", F.concat(F.lit("https://www.tracks.example.com/s/"), code))
            .when(kind == "3-MEDIUM", F.concat(F.lit("ftp://tracks.example.com/song/"), uuid))
            .when(kind == "5-LOW", F.concat(F.lit("https://other.example.org/song/"), uuid))
            .otherwise(F.lit(""))
        )
        state = F.col("o_orderstatus")
        return self.raw("orders").select(
            code.alias("request_id"),
            F.col("o_orderdate").alias("submitted_at"),
            url.alias("url"),
            F.when(state == "F", "processed").when(state == "O", "pending").otherwise("queued").alias("status"),
            F.lit("").alias("song_id"),
            F.lit("").alias("title"),
            F.lit(None).cast("timestamp_ntz").alias("processed_at"),
            F.lit("").alias("error"),
        )
