"""Playlists: saving ordered ids, listing, counting, appending."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartlake.functions.coerce import as_ts, strip
from chartlake.operators.ordinal import global_ordinal
from chartlake.operators.skew import salted_join


def playlist_positions(lists: DataFrame, base: int = 0) -> DataFrame:
    """(playlist_id, song_ids array) to unique positioned items; the first place wins.

    ``base=0`` numbers by place in the array, with gaps at blanks; ``base=1``
    counts only the non-blank ids.
    """
    ids = F.transform("song_ids", lambda x: F.coalesce(x, F.lit("")))
    if base == 1:
        ids = F.filter(ids, lambda x: strip(x) != "")
    items = lists.select("playlist_id", F.posexplode(ids).alias("position", "song_id"))
    items = items.where(strip("song_id") != "")
    first = items.groupBy("playlist_id", "song_id").agg(F.min("position").alias("position"))
    return first.withColumn("position", (F.col("position") + base).cast("int"))


def unique_items(items: DataFrame, *order: str) -> DataFrame:
    """Playlist rows with unique (playlist, song); the first in ``order`` wins."""
    w = Window.partitionBy("playlist_id", "song_id").orderBy("position", "added_at", *order)
    return items.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def playlist_counts(playlists: DataFrame, items: DataFrame) -> DataFrame:
    """Active playlists with their number of items (list newest first)."""
    counts = items.groupBy(F.col("playlist_id").alias("id")).agg(F.count("song_id").alias("song_count"))
    out = playlists.where(F.col("status") == "active").join(counts, "id", "left")
    return out.withColumn("song_count", F.coalesce("song_count", F.lit(0)))


def playlist_songs(
    playlists: DataFrame, items: DataFrame, songs: DataFrame, profiles: DataFrame, owner: str | None = None
) -> DataFrame:
    """Items of active playlists with song and uploader fields (order by position, added_at)."""
    lists = playlists.where(F.col("status") == "active").select(F.col("id").alias("playlist_id"), "owner_user_id")
    if owner is not None:
        lists = lists.where(F.col("owner_user_id") == owner)
    details = songs.select(F.col("id").alias("song_id"), "title", "uploader_user_id")
    names = profiles.select(F.col("user_id").alias("uploader_user_id"), F.col("display_name").alias("profile_name"))
    described = details.join(names, "uploader_user_id", "left")
    placed = salted_join(items, lists, ["playlist_id"])
    return salted_join(placed, described, ["song_id"], counted=items)


def playlist_append(items: DataFrame, additions: DataFrame) -> DataFrame:
    """New (playlist, song) rows at position count+1, count+2, ... per playlist.

    Songs already in the playlist are not added again. ``additions`` carries an
    ``added_at`` that orders it. Positions come from one distributed ordinal, so
    a playlist that receives most of the additions is not numbered by one task.
    """
    pair = ["playlist_id", "song_id"]
    new = additions.groupBy(*pair).agg(F.min("added_at").alias("added_at"))
    new = new.join(items.select(*pair), pair, "left_anti")
    order = [F.col("playlist_id").asc(), F.col("added_at").asc(), F.col("song_id").asc()]
    numbered = global_ordinal(new, order, "_row_number")
    starts = numbered.groupBy("playlist_id").agg((F.min("_row_number") - 1).alias("_start"))
    sizes = items.groupBy("playlist_id").agg(F.count(F.lit(1)).alias("_size"))
    base = starts.join(sizes, "playlist_id", "left")
    placed = salted_join(numbered, base, ["playlist_id"])
    position = F.coalesce("_size", F.lit(0)) + F.col("_row_number") - F.col("_start")
    return placed.withColumn("position", position.cast("int")).drop("_size", "_start", "_row_number")


def playlist_save(
    playlists: DataFrame,
    items: DataFrame,
    requests: DataFrame,
    as_of: str,
    default_name: str = "My Playlist",
    base: int = 0,
    max_name: int | None = None,
) -> dict[str, DataFrame]:
    """Create playlists or replace the items of existing ones, many requests at once.

    ``requests`` has request_id, playlist_id, owner_user_id, name and song_ids. A
    request without an owner, or for a playlist of another owner, is refused. A blank
    name becomes ``default_name``. Of requests for one playlist the last request_id
    counts, the others are superseded. A new playlist is private; an existing one keeps
    its visibility and other columns, and gets the name, the time and the items.
    ``playlists`` and ``items`` are the tables after all accepted requests, ``results``
    has one row per request: ok, message, name and song_count.
    """
    owners = playlists.select(F.col("id").alias("playlist_id"), F.col("owner_user_id").alias("_owner")).distinct()
    named = F.coalesce(F.nullif(strip(F.coalesce("name", F.lit(""))), F.lit("")), F.lit(default_name))
    checked = requests.join(owners, "playlist_id", "left").withColumn(
        "name", named if max_name is None else F.substring(named, 1, max_name)
    )
    ownerless = strip(F.coalesce("owner_user_id", F.lit(""))) == ""
    refused = (
        F.when(ownerless, "no owner")
        .when(F.col("_owner").isNotNull() & (F.col("_owner") != F.col("owner_user_id")), "playlist not found")
        .otherwise("")
    )
    # Of one playlist the accepted requests come first, the last of them ahead.
    last = Window.partitionBy("playlist_id").orderBy((F.col("message") == "").desc(), F.col("request_id").desc())
    checked = checked.withColumn("message", refused).withColumn("_n", F.row_number().over(last))
    superseded = (F.col("message") == "") & (F.col("_n") > 1)
    checked = checked.withColumn("message", F.when(superseded, "superseded").otherwise(F.col("message")))
    accepted = checked.where(F.col("message") == "")
    placed = playlist_positions(accepted.select("playlist_id", "song_ids"), base).withColumn("added_at", as_ts(as_of))
    counts = placed.groupBy("playlist_id").agg(F.count(F.lit(1)).alias("song_count"))
    new = accepted.where(F.col("_owner").isNull()).select(
        F.col("playlist_id").alias("id"), "owner_user_id", "name", F.lit("private").alias("visibility"), F.lit("active").alias("status"),
        as_ts(as_of).alias("updated_at"),
    )
    changes = accepted.select(F.col("playlist_id").alias("id"), F.col("name").alias("_name"))
    kept_lists = playlists.join(changes, "id", "left")
    touched = F.col("_name").isNotNull()
    saved = {"name": F.coalesce("_name", "name"), "status": F.when(touched, F.lit("active")).otherwise(F.col("status")),
             "updated_at": F.when(touched, as_ts(as_of)).otherwise(F.col("updated_at"))}
    kept_lists = kept_lists.withColumns(saved).drop("_name")
    ok = F.col("message") == ""
    result = checked.join(counts, "playlist_id", "left").select(
        "request_id", "playlist_id", ok.alias("ok"), "message", "name",
        F.when(ok, F.coalesce("song_count", F.lit(0))).otherwise(0).cast("long").alias("song_count"),
    )
    kept = salted_join(items, accepted.select("playlist_id"), ["playlist_id"], "left_anti")
    return {
        "playlists": kept_lists.unionByName(new, allowMissingColumns=True).select(*playlists.columns),
        "items": kept.unionByName(placed, allowMissingColumns=True),
        "results": result,
    }


def ordered_song_ids(playlists: DataFrame, items: DataFrame, playlist_id: str, owner: str) -> DataFrame:
    """Song ids of one owner's active playlist in order (``song_id``, ``position``)."""
    own = (F.col("id") == playlist_id) & (F.col("owner_user_id") == owner) & (F.col("status") == "active")
    mine = playlists.where(own).select(F.col("id").alias("playlist_id"))
    found = items.join(mine, "playlist_id", "left_semi").orderBy("position", "added_at", "song_id")
    return found.select("song_id", F.coalesce("position", F.lit(0)).alias("position"))


def public_playlists(playlists: DataFrame, limit: int = 30) -> DataFrame:
    shown = playlists.where((F.col("visibility") == "public") & (F.col("status") == "active"))
    return shown.orderBy(F.col("updated_at").desc_nulls_last(), F.col("id").asc()).limit(limit)


def register_playlist_functions(playlists: DataFrame, items: DataFrame) -> None:
    """Temporary SQL table functions over the given tables.

    ``list_playlists(owner)`` gives the owner's active playlists with their number of
    songs, ``playlist_song_ids(owner, playlist)`` the songs of one of them with their
    positions. A caller orders by updated_at, or by position, added_at and song_id.
    """
    spark = playlists.sparkSession
    playlists.createOrReplaceTempView("chartlake_playlists")
    items.createOrReplaceTempView("chartlake_playlist_items")
    kinds = {name: playlists.schema[name].dataType.simpleString() for name in ("id", "updated_at")}
    kinds |= {name: items.schema[name].dataType.simpleString() for name in ("song_id", "added_at")}
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION list_playlists(owner STRING)
        RETURNS TABLE(id {kinds["id"]}, name STRING, song_count BIGINT, updated_at {kinds["updated_at"]})
        RETURN SELECT p.id, p.name, count(i.song_id), p.updated_at
          FROM chartlake_playlists p LEFT JOIN chartlake_playlist_items i ON i.playlist_id = p.id
          WHERE p.owner_user_id = list_playlists.owner AND p.status = 'active'
          GROUP BY p.id, p.name, p.updated_at"""
    )
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION playlist_song_ids(owner STRING, playlist {kinds["id"]})
        RETURNS TABLE(song_id {kinds["song_id"]}, position INT, added_at {kinds["added_at"]})
        RETURN SELECT i.song_id, CAST(coalesce(i.position, 0) AS INT), i.added_at
          FROM chartlake_playlist_items i JOIN chartlake_playlists p ON p.id = i.playlist_id
          WHERE p.id = playlist_song_ids.playlist AND p.owner_user_id = playlist_song_ids.owner AND p.status = 'active'"""
    )
