"""Community side: events, counters, playlists, comments."""
from __future__ import annotations

from pyspark.sql import functions as F

from chartlake.functions.scores import community_score, play_qualifies, register_sql_functions
from chartlake.operators import engagement, playlists
from chartlake.plans import upkeep
from chartlake.sources.driver import AS_OF
from checks.ingest_checks import work_folder
from checks.registry import check

TERMS = ("theheron", "lythwh", "êaux", "reanle")


def counters(d):
    plays = engagement.unique_plays(d.play_events())
    likes = engagement.liked_pairs(d.like_toggles())
    return engagement.song_counters(d.app_songs(), plays, likes, d.app_comments(), AS_OF)


@check("song_counters", "SELECT id, play_count, like_count, comment_count, trend_score FROM v_counters")
def song_counters(d):
    return counters(d).select("id", "play_count", "like_count", "comment_count", "trend_score")


@check(
    "community_score",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(ln(1 + l_quantity) + 3 * ln(1 + l_linenumber)
         + 4 * ln(1 + l_discount * 100) + 30 * pow(greatest(0, 1 - greatest(date_diff('microsecond', l_shipdate,
         TIMESTAMP '1999-06-17'), 0) / 604800000000.0), 1.25), 6) AS score FROM lineitem""",
)
def community_score_lines(d):
    hits = (F.col("l_discount") * 100).alias("c")
    score = community_score("l_quantity", "l_linenumber", hits, "l_shipdate", "1999-06-17 00:00:00")
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return d.raw("lineitem").select(*keys, score.alias("score"))


@check("community_score_sql", "SELECT id, trend_score AS score FROM v_counters")
def community_score_sql(d):
    register_sql_functions(d.spark)
    as_of = f"TIMESTAMP_NTZ'{AS_OF}'"
    return counters(d).selectExpr("id", f"community_score(play_count, like_count, comment_count, created_at, {as_of}) AS score")


@check("public_songs", "SELECT id, title FROM v_app_songs WHERE visibility = 'public' AND status = 'active'")
def public_songs(d):
    return engagement.public_songs(d.app_songs()).select("id", "title")


@check(
    "songs_with_profile",
    """SELECT s.id, p.display_name AS profile_name, p.avatar_url AS profile_avatar,
         CASE WHEN s.artist_name <> '' THEN s.artist_name ELSE coalesce(p.display_name, 'Unknown') END AS creator
       FROM v_app_songs s LEFT JOIN v_profiles p ON p.user_id = s.uploader_user_id""",
)
def songs_with_profile(d):
    from chartlake.functions.text import community_creator

    out = engagement.songs_with_profile(d.app_songs(), d.profiles())
    creator = community_creator("artist_name", "profile_name").alias("creator")
    return out.select("id", "profile_name", "profile_avatar", creator)


@check(
    "liked_flags",
    "SELECT s.id, s.id IN (SELECT song_id FROM v_likes WHERE actor_key = 'user:7') AS liked FROM v_app_songs s",
)
def liked_flags(d):
    likes = engagement.liked_pairs(d.like_toggles())
    return engagement.liked_flags(d.app_songs(), likes, "user:7").select("id", "liked")


@check(
    "app_song_stats",
    """WITH p AS (SELECT song_id, count(*) AS n, count(DISTINCT user_id) AS u FROM v_play_events WHERE counted GROUP BY 1),
            l AS (SELECT song_id, count(*) AS n FROM v_likes GROUP BY 1)
       SELECT coalesce(p.song_id, l.song_id) AS song_id, coalesce(p.n, 0) AS app_play_count, coalesce(l.n, 0) AS app_like_count,
              coalesce(p.u, 0) AS unique_listener_count FROM p FULL JOIN l ON p.song_id = l.song_id""",
)
def app_song_stats(d):
    return engagement.app_song_stats(d.play_events(), engagement.liked_pairs(d.like_toggles()))


@check(
    "play_qualify",
    """SELECT event_id, coalesce(value >= 10 AND value * k / 100 / value >= 0.30, false) AS counts_strict,
              coalesce(value > 0 AND value * k / 100 / value >= 0.30, false) OR k >= 99 AS counts_or_ended
       FROM v_play_events""",
)
def play_qualify(d):
    position = F.col("value") * F.col("k") / 100
    return d.play_events().select(
        "event_id",
        play_qualifies("value", position).alias("counts_strict"),
        play_qualifies("value", position, F.col("k") >= 99).alias("counts_or_ended"),
    )


@check(
    "community_tabs",
    """WITH v AS (SELECT * FROM v_counters WHERE visibility = 'public' AND status = 'active')
       SELECT 'trending' AS tab, row_number() OVER (ORDER BY trend_score DESC, created_at DESC, id) AS rank, id FROM v QUALIFY rank <= 300
       UNION ALL SELECT 'new', row_number() OVER (ORDER BY created_at DESC, id) AS rank, id FROM v QUALIFY rank <= 300
       UNION ALL SELECT 'liked', row_number() OVER (ORDER BY like_count DESC, created_at DESC, id) AS rank, id FROM v QUALIFY rank <= 300
       UNION ALL SELECT 'played', row_number() OVER (ORDER BY play_count DESC, created_at DESC, id) AS rank, id FROM v QUALIFY rank <= 300""",
)
def community_tabs(d):
    return engagement.community_tabs(counters(d)).select("tab", "rank", "id")


@check(
    "latest_comments",
    """SELECT song_id, id, row_number() OVER (PARTITION BY song_id ORDER BY created_at DESC, id) AS position
       FROM v_app_comments WHERE status = 'visible' QUALIFY position <= 2""",
)
def latest_comments(d):
    out = engagement.latest_comments(d.app_comments(), 2)
    return out.select("song_id", "id", F.col("position").cast("long").alias("position"))


@check(
    "comment_admissible",
    """WITH c AS (SELECT c.id, coalesce(s.comments_enabled, false) AS on_, trim(c.body, ' \t\n\r') AS b
                  FROM v_app_comments c LEFT JOIN v_app_songs s ON s.id = c.song_id),
            r AS (SELECT id, CASE WHEN NOT on_ THEN 'comments disabled' WHEN len(b) < 2 THEN 'too short' WHEN len(b) > 500 THEN 'too long'
              WHEN contains(replace(lower(b), ' ', ''), 'theheron') OR contains(replace(lower(b), ' ', ''), 'lythwh')
                OR contains(replace(lower(b), ' ', ''), 'êaux') OR contains(replace(lower(b), ' ', ''), 'reanle')
                THEN 'listed term' ELSE '' END AS reason FROM c)
       SELECT id, reason, reason = '' AS accepted FROM r""",
)
def comment_admissible(d):
    out = engagement.admissible_comments(d.app_comments(), d.app_songs(), TERMS)
    return out.select("id", "reason", "accepted")


@check(
    "comment_like_counts",
    """WITH n AS (SELECT count(DISTINCT conv_id) AS convs, max(turn) + 1 AS turns FROM conversations),
         l AS (SELECT (event_id // turns % convs)::VARCHAR || '-' || (event_id % turns)::VARCHAR AS id, user_id FROM events, n
                  WHERE event_type = 'click' AND len('user:' || user_id) >= 6 GROUP BY ALL HAVING count(*) % 2 = 1)
       SELECT t.id, count(l.user_id) AS like_count FROM (SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS id FROM conversations) t
       LEFT JOIN l ON l.id = t.id GROUP BY t.id""",
)
def comment_like_counts(d):
    """Each click toggles the like of one comment; clicks go through all conversations and turns in order."""
    size = d.raw("conversations").agg(F.count_distinct("conv_id").alias("_convs"), (F.max("turn") + 1).alias("_turns"))
    number = F.col("event_id")
    comment = F.concat((F.floor(number / F.col("_turns")) % F.col("_convs")).cast("string"), F.lit("-"), (number % F.col("_turns")).cast("string"))
    toggles = d.like_toggles().crossJoin(F.broadcast(size)).withColumn("comment_id", comment)
    likes = engagement.liked_pairs(toggles, "comment_id")
    return engagement.comment_like_counts(d.app_comments(), likes).select("id", "like_count")


@check(
    "playlist_counts",
    """SELECT p.id, p.name, p.updated_at, count(i.song_id) AS song_count FROM v_playlists p
       LEFT JOIN v_items i ON i.playlist_id = p.id WHERE p.status = 'active' GROUP BY ALL""",
)
def playlist_counts(d):
    out = playlists.playlist_counts(d.playlists(), d.unique_playlist_items())
    return out.select("id", "name", "updated_at", "song_count")


@check(
    "playlist_songs",
    """SELECT i.playlist_id, i.song_id, i.position, i.added_at, s.title, f.display_name AS profile_name FROM v_items i
       JOIN v_playlists p ON p.id = i.playlist_id AND p.status = 'active' JOIN v_app_songs s ON s.id = i.song_id
       LEFT JOIN v_profiles f ON f.user_id = s.uploader_user_id""",
)
def playlist_songs(d):
    out = playlists.playlist_songs(d.playlists(), d.stored("unique_playlist_items"), d.app_songs(), d.profiles())
    return out.select("playlist_id", "song_id", "position", "added_at", "title", "profile_name")


@check(
    "playlist_explode",
    """WITH w AS (SELECT doc_id, string_split(text, ' ') AS ids FROM documents),
       e AS (SELECT doc_id, ids[i] AS song_id, i - 1 AS p FROM (SELECT doc_id, ids, unnest(range(1, len(ids) + 1)) AS i FROM w)),
       k AS (SELECT *, trim(song_id, ' \t\n\r') <> '' AS filled FROM e),
       o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS q FROM k WHERE filled)
       SELECT doc_id::VARCHAR AS playlist_id, song_id, min(p)::INT AS position, min(q)::INT AS counted_position
       FROM o GROUP BY ALL""",
)
def playlist_explode(d):
    lists = d.raw("documents").select(F.col("doc_id").cast("string").alias("playlist_id"), F.split("text", " ").alias("song_ids"))
    zero = playlists.playlist_positions(lists, 0)
    one = playlists.playlist_positions(lists, 1).withColumnRenamed("position", "counted_position")
    return zero.join(one, ["playlist_id", "song_id"])


@check(
    "playlist_append",
    """WITH base AS (SELECT * FROM v_items WHERE position <= 4), add AS (
         SELECT playlist_id, song_id, min(added_at) AS added_at FROM (
           SELECT l_orderkey::VARCHAR AS playlist_id, l_partkey::VARCHAR AS song_id, l_shipdate AS added_at FROM lineitem)
         WHERE (playlist_id, song_id) NOT IN (SELECT (playlist_id, song_id) FROM base) GROUP BY ALL),
       n AS (SELECT playlist_id, count(*) AS n FROM base GROUP BY 1)
       SELECT add.playlist_id, song_id, added_at, (coalesce(n, 0)
         + row_number() OVER (PARTITION BY add.playlist_id ORDER BY added_at, song_id))::INT AS position
       FROM add LEFT JOIN n ON n.playlist_id = add.playlist_id""",
)
def playlist_append(d):
    base = d.stored("unique_playlist_items").where(F.col("position") <= 4)
    additions = d.playlist_items().select("playlist_id", "song_id", "added_at")
    return playlists.playlist_append(base, additions).select("playlist_id", "song_id", "added_at", "position")


SAVE_SQL = """
    WITH q AS (SELECT o_orderkey AS request_id, o_orderkey::VARCHAR AS playlist_id, o_orderstatus,
        CASE WHEN o_orderstatus = 'P' THEN '' WHEN o_custkey % 7 = 0 THEN 'other' ELSE 'user' || o_custkey END AS owner,
        CASE WHEN o_custkey % 2 = 0 THEN 'My Playlist' ELSE o_orderpriority END AS name,
        CASE WHEN o_orderstatus = 'P' THEN 'no owner' WHEN o_custkey % 7 = 0 THEN 'playlist not found' ELSE '' END AS message
      FROM orders),
    w AS (SELECT l_orderkey::VARCHAR AS playlist_id, list_distinct(list(l_suppkey::VARCHAR)) AS ids FROM lineitem GROUP BY 1),
    r AS (SELECT q.*, CASE WHEN message = '' THEN coalesce(len(ids), 0) ELSE 0 END AS song_count, ids
      FROM q LEFT JOIN w USING (playlist_id))
"""


def saved_playlists(d):
    """Every order as a save request: its lines' suppliers, in reverse, with a blank."""
    key = F.col("o_orderkey")
    lines = d.raw("lineitem").groupBy("l_orderkey").agg(
        F.reverse(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", F.col("l_suppkey").cast("string").alias("s"))))).alias("ids")
    )
    ids = F.concat(F.array(F.lit(" ")), F.coalesce(F.transform("ids", lambda x: x["s"]), F.array().cast("array<string>")))
    user = F.concat(F.lit("user"), F.col("o_custkey").cast("string"))
    orders = d.raw("orders").join(lines, F.col("l_orderkey") == key, "left")
    requests = orders.select(
        key.alias("request_id"), key.cast("string").alias("playlist_id"),
        F.when(F.col("o_orderstatus") == "P", "").when(F.col("o_custkey") % 7 == 0, "other").otherwise(user).alias("owner_user_id"),
        F.when(F.col("o_custkey") % 2 == 0, "  ").otherwise(F.col("o_orderpriority")).alias("name"), ids.alias("song_ids"),
    )
    return playlists.playlist_save(d.playlists(), d.unique_playlist_items(), requests, AS_OF)


@check("playlist_save", SAVE_SQL + "SELECT request_id, playlist_id, message = '' AS ok, message, name, song_count FROM r")
def playlist_save(d):
    return saved_playlists(d)["results"]


@check(
    "playlist_save_items",
    SAVE_SQL
    + """SELECT playlist_id, song_id FROM v_items WHERE playlist_id NOT IN (SELECT playlist_id FROM r WHERE message = '')
         UNION ALL SELECT playlist_id, unnest(ids) FROM r WHERE message = ''""",
)
def playlist_save_items(d):
    return saved_playlists(d)["items"].select("playlist_id", "song_id")


@check(
    "playlist_save_lists",
    SAVE_SQL
    + """SELECT p.id, p.owner_user_id, coalesce(r.name, p.name) AS name, p.visibility,
           CASE WHEN r.request_id IS NOT NULL THEN 'active' ELSE p.status END AS status,
           CASE WHEN r.request_id IS NOT NULL THEN TIMESTAMP '2024-01-31' ELSE p.updated_at END AS updated_at
         FROM v_playlists p LEFT JOIN r ON r.playlist_id = p.id AND r.message = ''""",
)
def playlist_save_lists(d):
    return saved_playlists(d)["playlists"]


@check(
    "sql_list_playlists",
    """SELECT p.owner_user_id, p.id, p.name, count(i.song_id) AS song_count, p.updated_at FROM v_playlists p
       LEFT JOIN v_items i ON i.playlist_id = p.id WHERE p.status = 'active' GROUP BY ALL""",
)
def sql_list_playlists(d):
    """Every owner's list, through the SQL table function."""
    playlists.register_playlist_functions(d.stored("playlists"), d.stored("unique_playlist_items"))
    return d.spark.sql(
        """SELECT o.owner_user_id, l.* FROM (SELECT DISTINCT owner_user_id FROM chartlake_playlists) o,
           LATERAL list_playlists(o.owner_user_id) l"""
    )


@check(
    "sql_playlist_song_ids",
    """SELECT p.owner_user_id, p.id, i.song_id, i.position, i.added_at FROM v_playlists p JOIN v_items i ON i.playlist_id = p.id
       WHERE p.status = 'active'""",
)
def sql_playlist_song_ids(d):
    """The songs of every playlist, through the SQL table function."""
    playlists.register_playlist_functions(d.stored("playlists"), d.stored("unique_playlist_items"))
    return d.spark.sql(
        """SELECT p.owner_user_id, p.id, s.song_id, s.position, s.added_at
           FROM chartlake_playlists p, LATERAL playlist_song_ids(p.owner_user_id, p.id) s"""
    )


@check(
    "listeners_by_sketch",
    """SELECT song_id, count(DISTINCT user_id) AS listener_count, TRUE AS within_bound FROM v_play_events
       WHERE counted AND user_id IS NOT NULL GROUP BY song_id""",
)
def listeners_by_sketch(d):
    """Estimates from sketches of three batches against the exact count: within 5 % and one."""
    table = upkeep.listener_table(d.spark, work_folder(d, "listeners"))
    plays = d.play_events()
    for k in range(3):
        table.append(engagement.listener_sketches(plays.where(F.col("event_id") % 3 == k)), "plays", k)
    table.fold(upkeep.merge_sketches, over=1)
    exact = plays.where("counted and user_id is not null").groupBy("song_id").agg(F.count_distinct("user_id").alias("exact"))
    both = exact.join(engagement.listeners_of(table.read()), "song_id", "full")
    near = F.abs(F.col("listener_count") - F.col("exact")) <= F.col("exact") * 0.05 + 1
    return both.select("song_id", F.col("exact").alias("listener_count"), F.coalesce(near, F.lit(False)).alias("within_bound"))


@check(
    "public_playlists",
    """SELECT id, updated_at FROM v_playlists WHERE visibility = 'public' AND status = 'active'
       ORDER BY updated_at DESC, id LIMIT 30""",
)
def public_playlists(d):
    return playlists.public_playlists(d.playlists()).select("id", "updated_at")


@check("own_songs", "SELECT id, created_at FROM v_app_songs WHERE uploader_user_id = 'user3'")
def own_songs(d):
    return engagement.own_songs(d.app_songs(), "user3").select("id", "created_at")


@check(
    "delete_cascade",
    """SELECT i.playlist_id, i.song_id FROM v_items i WHERE i.playlist_id NOT IN (
         SELECT id FROM v_playlists WHERE owner_user_id IN ('user3', 'user5', 'user7') OR status = 'deleted')""",
)
def delete_cascade(d):
    lists = d.playlists()
    doomed = lists.where(F.col("owner_user_id").isin("user3", "user5", "user7") | (F.col("status") == "deleted"))
    _, items = engagement.delete_cascade(lists, doomed, d.unique_playlist_items(), "id", "playlist_id")
    return items.select("playlist_id", "song_id")


@check(
    "soft_delete",
    """SELECT id, CASE WHEN uploader_user_id = 'user3' AND title LIKE '%gear%' THEN 'deleted' ELSE status END AS status,
              CASE WHEN uploader_user_id = 'user3' AND title LIKE '%gear%' THEN 'private' ELSE visibility END AS visibility
       FROM v_app_songs""",
)
def soft_delete(d):
    songs = d.app_songs()
    doomed = songs.where((F.col("uploader_user_id") == "user3") & F.contains("title", F.lit("gear")))
    return engagement.soft_delete(songs, doomed).select("id", "status", "visibility")
