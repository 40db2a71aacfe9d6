"""Landed JSON, CSV and snapshot tables, refresh jobs."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartlake.config import TierConfig
from chartlake.operators import catalog
from chartlake.plans import jobs, upkeep
from chartlake.plans.refresh import ChartTables, refresh_tables
from chartlake.session import measured_broadcasts, shared_folder
from chartlake.sources import feeds, tables
from chartlake.sources.driver import AS_OF
from chartlake.sources.parts import KeyedTable
from checks.registry import check

TIERS = TierConfig(warm_handles=("@U3", "u5", "u7", "u11"))


def work_folder(d, name: str) -> str:
    """A new folder per run under the shared folder."""
    return f"{shared_folder(d.spark)}/{name}-{uuid.uuid4().hex}"


@check("csv_roundtrip", "SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, role, text, '' AS note FROM conversations")
def csv_roundtrip(d):
    folder = work_folder(d, "csv")
    tables.write_csv(d.raw("conversations"), folder)
    return tables.read_csv(d.spark, folder, ("conv_id", "turn", "role", "text", "note"))


@check(
    "snapshot_replace",
    "SELECT id, play_count + 1 AS play_count FROM v_songs",
)
def snapshot_replace(d):
    table = work_folder(d, "songs")
    tables.replace_snapshot(d.songs().select("id", "play_count"), table)
    first = tables.read_snapshot(d.spark, table)
    tables.replace_snapshot(first.withColumn("play_count", F.col("play_count") + 1), table)
    return tables.read_snapshot(d.spark, table)


def record(d):
    """Item record per catalogue row; where a field sits depends on the counters."""
    songs = d.songs()
    top, in_clip = F.col("play_count") > 1, F.col("upvote_count") > 1
    tags = F.split("display_tags", ", ")
    return songs.withColumn(
        "record",
        F.to_json(
            F.struct(
                "id",
                F.when(top, F.col("title")).otherwise("  ").alias("title"),
                F.when(~in_clip, F.col("play_count")).alias("play_count"),
                F.col("upvote_count").alias("likeCount"),
                F.col("is_contest_clip"),
                F.col("download_disabled_reason"),
                F.when(in_clip, F.concat(F.lit("[Verse]\n{"), "title", F.lit('}"'))).alias("lyrics"),
                F.struct(
                    F.when(in_clip, F.col("play_count")).alias("play_count"),
                    F.concat(F.lit("clip of "), "title").alias("title"),
                    F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("createdAt"),
                ).alias("clip"),
                F.struct("handle", F.col("user_id").alias("id")).alias("user"),
                F.struct(
                    F.when(top, tags).alias("tags"),
                    F.col("duration"),
                    F.struct(F.lit("none").alias("text")).alias("prompt"),
                    F.when(F.col("comment_count") >= 4, F.array(F.lit("c-1"), F.lit("-"))).otherwise(F.array()).alias("contest_ids"),
                ).alias("metadata"),
            )
        ),
    )


RECORD_SQL = """
    SELECT id, CASE WHEN play_count > 1 THEN title ELSE 'clip of ' || title END AS title, handle, user_id, created_at,
      play_count, upvote_count, 0::BIGINT AS comment_count, is_contest_clip, download_disabled_reason,
      CASE WHEN comment_count >= 4 THEN 'c-1' END AS contest_ids,
      CASE WHEN play_count > 1 THEN display_tags ELSE '' END AS display_tags, duration,
      CASE WHEN upvote_count > 1 THEN '[Verse]' || chr(10) || '{' || title || '}"' ELSE '' END AS lyrics,
      '' AS prompt, 'https://tracks.example.com/song/' || id AS song_url, 'public' AS source FROM v_songs
"""
RECORD_COLUMNS = (
    "id", "title", "handle", "user_id", "created_at", "play_count", "upvote_count", "comment_count", "is_contest_clip",
    "download_disabled_reason", "contest_ids", "display_tags", "duration", "lyrics", "prompt", "song_url", "source",
)


@check("record_flatten", RECORD_SQL)
def record_flatten(d):
    return feeds.flatten_records(record(d).select("id", "record"), None, AS_OF).select(*RECORD_COLUMNS)


@check(
    "record_flatten_previous",
    """SELECT id, 'kept ' || title AS title, comment_count + 3 AS comment_count, play_count, 'old' AS source,
         'warm' AS update_tier, -9.5::DOUBLE AS integrated_lufs, first_seen_at, TIMESTAMP '2024-01-31' AS last_checked_at FROM v_songs""",
)
def record_flatten_previous(d):
    """Fields absent from the record and columns it does not cover come from before."""
    previous = d.songs().withColumns(
        {
            "title": F.concat(F.lit("kept "), "title"),
            "comment_count": F.col("comment_count") + 3,
            "source": F.lit("old"),
            "update_tier": F.lit("warm"),
            "integrated_lufs": F.lit(-9.5),
        }
    )
    sparse = d.songs().select("id", F.to_json(F.struct("id", "play_count", F.lit("-").alias("title"))).alias("record"))
    out = feeds.flatten_records(sparse, previous, AS_OF)
    return out.select(
        "id", "title", "comment_count", "play_count", "source", "update_tier", "integrated_lufs", "first_seen_at",
        "last_checked_at",
    )


@check(
    "contest_flag",
    """SELECT id, is_contest_clip OR comment_count >= 4 OR coalesce(download_disabled_reason, '') = 'remix_contest' AS is_contest
       FROM v_songs""",
)
def contest_flag(d):
    return record(d).select("id", feeds.contest_flag("record").alias("is_contest"))


def feed_pages(d):
    """One feed page per catalogue row: a clip, another kind of item, a clip without id."""
    clip = F.concat(F.lit('{"content_type":"clip","content_item":'), "record", F.lit("}"))
    return record(d).select(
        F.col("id").alias("page_id"),
        F.concat(
            F.lit('{"feed":{"items":[{"content_type":"banner","content_item":{"id":"b"}},'), clip,
            F.lit(',{"content_type":"clip","content_item":{"id":""}}],"next_cursor":"2"}}'),
        ).alias("body"),
    )


@check(
    "feed_explode",
    """SELECT id AS page_id, 1 AS item_position, id, is_contest_clip OR comment_count >= 4
         OR coalesce(download_disabled_reason, '') = 'remix_contest' AS is_contest FROM v_songs""",
)
def feed_explode(d):
    return feeds.feed_items(feed_pages(d)).select("page_id", "item_position", "id", "is_contest")


@check("page_embedded_json", "SELECT page_id, url, html FROM pages UNION ALL SELECT -1 - page_id, NULL, NULL FROM pages")
def page_embedded_json(d):
    """Whole pages packed into an object inside a longer text, and pages without one."""
    pages = d.raw("pages")
    packed = F.to_json(F.struct("page_id", "url", "html"))
    body = F.concat(F.lit('<script>push("x",{"a":{"clips":1}},"clip": '), packed, F.lit(',"tail":{"b":"}"}]</script>'))
    bare = pages.select((-1 - F.col("page_id")).alias("page_id"), F.concat(F.lit("no object {"), "url").alias("body"))
    texts = pages.select("page_id", body.alias("body")).unionByName(bare)
    found = texts.select("page_id", feeds.embedded_object("body").alias("o"))
    return found.select("page_id", F.get_json_object("o", "$.url").alias("url"), F.get_json_object("o", "$.html").alias("html"))


@check(
    "comments_flatten",
    """WITH l AS (SELECT doc_id, source, lines, unnest(range(1, len(lines) + 1)) AS pos
                  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents)),
            k AS (SELECT *, lines[pos] AS line FROM l)
       SELECT doc_id::VARCHAR AS song_id, doc_id || '-' || (pos - 1) AS comment_id, trim(line, ' \t\n\r') AS content, source AS user_handle,
         pos - 1 AS num_likes, 1 AS num_replies, false AS is_reply FROM k WHERE trim(line, ' \t\n\r') <> ''
       UNION ALL SELECT doc_id::VARCHAR, doc_id || '-' || (pos - 1) || '-r', 're ' || trim(line, ' \t\n\r'), 'u' || doc_id, 0, 0, true FROM k""",
)
def comments_flatten(d):
    """Landed pages of 20 lines of a document: each line is a comment with one reply."""
    key = F.col("doc_id").cast("string")

    def comment(line, i):
        cid = F.concat(key, F.lit("-"), i.cast("string"))
        reply = F.struct(
            F.concat(cid, F.lit("-r")).alias("id"),
            F.concat(F.lit("re "), F.btrim(line, F.lit(" \t\n\r")), F.lit(" ")).alias("content"),
            F.concat(F.lit("u"), key).alias("user_handle"),
        )
        return F.struct(
            cid.alias("id"), line.alias("content"), F.col("source").alias("user_handle"), i.alias("num_likes"),
            F.lit(1).alias("num_replies"), F.array(reply).alias("replies"),
        )

    lines = F.transform(F.split("text", "\n"), comment)
    # Pages are cut inside of the row, so that no page carries all lines.
    starts = F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / 20).cast("int"))
    cut = F.transform(starts, lambda p: F.slice("lines", p * 20 + 1, F.lit(20)))
    listed = d.raw("documents").select(key.alias("song_id"), lines.alias("lines"))
    paged = listed.select("song_id", F.posexplode(cut).alias("page_no", "page"))
    pages = paged.select("song_id", "page_no", F.to_json(F.struct(F.col("page").alias("results"))).alias("body"))
    out = feeds.flatten_comments(pages)
    return out.select("song_id", "comment_id", "content", "user_handle", "num_likes", "num_replies", "is_reply")


# Refresh jobs -----------------------------------------------------------------
def landed_items(d):
    """Detail pages of catalogue items: ten more plays, or an error for unplayed ones."""
    grown = F.to_json(F.struct("id", (F.col("play_count") + 10).alias("play_count")))
    played = F.col("play_count") > 0
    return d.songs().select(
        "id", F.when(played, grown).alias("record"), F.when(~played, F.lit("HTTP 404")).alias("error")
    )


def discovered(d):
    """One feed item per part."""
    key = F.concat(F.lit("new-"), F.col("p_partkey").cast("string"))
    created = F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(hours=F.col("p_size"))
    item = F.to_json(
        F.struct(key.alias("id"), F.col("p_name").alias("title"), F.date_format(created, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))
    )
    return d.raw("part").select(
        key.alias("id"), item.alias("record"), F.col("p_partkey").alias("page_id"), F.lit(0).alias("item_position")
    )


REFRESH_SQL = """
    WITH k AS (
      SELECT id, title, handle, status, fetch_fail_count, created_at, last_checked_at, next_check_at, play_count FROM v_songs
      UNION ALL SELECT 'new-' || p_partkey, p_name, '', 'active', 0, TIMESTAMP '2024-01-31' - to_hours(p_size),
        TIMESTAMP '2024-01-31', NULL, 0 FROM part),
    t AS (SELECT k.*, CASE WHEN status = 'private' OR fetch_fail_count >= 10 THEN 'frozen'
        WHEN created_at >= TIMESTAMP '2024-01-27' THEN 'hot' WHEN r.song_id IS NOT NULL THEN 'playlist'
        WHEN handle IN ('u3', 'u5', 'u7', 'u11') THEN 'warm' ELSE 'cold' END AS tier FROM k LEFT JOIN v_item_refs r ON r.song_id = k.id),
    due AS (SELECT *, CASE tier WHEN 'hot' THEN 0 WHEN 'playlist' THEN 1 WHEN 'warm' THEN 2 WHEN 'cold' THEN 3 ELSE 4 END AS pr FROM t
      WHERE CASE WHEN next_check_at IS NOT NULL THEN next_check_at <= TIMESTAMP '2024-01-31' ELSE last_checked_at <= TIMESTAMP '2024-01-31'
        - to_hours(CASE tier WHEN 'hot' THEN 0 WHEN 'playlist' THEN 24 WHEN 'warm' THEN 6 WHEN 'frozen' THEN 168 ELSE 72 END) END),
    sel AS (SELECT id FROM due),
    u AS (SELECT t.id, t.title, t.created_at, t.handle,
        sel.id IS NOT NULL AND t.id NOT LIKE 'new-%' AND t.play_count > 0 AS ok,
        sel.id IS NOT NULL AND t.id NOT LIKE 'new-%' AND t.play_count = 0 AS bad, t.play_count, t.fetch_fail_count, t.status, t.tier
      FROM t LEFT JOIN sel ON sel.id = t.id)
"""


CATALOG_SQL = (
    REFRESH_SQL
    + """SELECT id, title, created_at, CASE WHEN ok THEN play_count + 10 ELSE play_count END AS play_count,
           CASE WHEN ok THEN 0 WHEN bad THEN fetch_fail_count + 1 ELSE fetch_fail_count END AS fetch_fail_count,
           CASE WHEN ok THEN 'active' WHEN bad THEN 'frozen' WHEN status = '' THEN 'active' ELSE status END AS status,
           CASE WHEN bad THEN 'frozen' WHEN NOT ok OR (status <> 'private' AND fetch_fail_count < 10) THEN tier
                WHEN created_at >= TIMESTAMP '2024-01-27' THEN 'hot'
                WHEN id IN (SELECT song_id FROM v_item_refs) THEN 'playlist' WHEN handle IN ('u3', 'u5', 'u7', 'u11') THEN 'warm'
                ELSE 'cold' END AS update_tier, ok AS changed FROM u"""
)


@check("catalog_refresh", CATALOG_SQL)
def catalog_refresh(d):
    out = jobs.catalog_refresh(
        d.songs(gaps=True), d.stored("song_history"), discovered(d), landed_items(d), d.item_references(), AS_OF, TIERS
    )["songs"]
    changed = F.coalesce(F.col("last_change_at") == F.lit(AS_OF).cast("timestamp_ntz"), F.lit(False))
    return out.select(
        "id", "title", "created_at", "play_count", "fetch_fail_count", "status", "update_tier", changed.alias("changed")
    )


CATALOG_HISTORY_SQL = (
    REFRESH_SQL
    + """SELECT id, checked_at, play_count FROM v_history WHERE checked_at >= TIMESTAMP '2024-01-24'
         UNION ALL SELECT id, checked_at, play_count FROM (SELECT * FROM v_history WHERE checked_at < TIMESTAMP '2024-01-24'
           QUALIFY row_number() OVER (PARTITION BY id, checked_at::DATE
             ORDER BY checked_at DESC, play_count + upvote_count + comment_count DESC) = 1)
         UNION ALL SELECT id, TIMESTAMP '2024-01-31', play_count + 10 FROM u WHERE ok"""
)


@check("catalog_refresh_history", CATALOG_HISTORY_SQL)
def catalog_refresh_history(d):
    out = jobs.catalog_refresh(
        d.songs(gaps=True), d.stored("song_history"), discovered(d), landed_items(d), d.item_references(), AS_OF, TIERS
    )["song_history"]
    return out.select("id", "checked_at", "play_count")


def refreshed_tables(d):
    """The same refresh in place: stored tables, one run, and the same run once more."""
    songs, history = d.songs(gaps=True), d.song_history()
    extra = "playlist_ref_count boolean, update_tier string, last_change_at timestamp_ntz, comments_fetch_needed boolean, last_fetch_error string"
    schema = T.StructType([*songs.schema.fields, *T.StructType.fromDDL(extra).fields])
    stored = ChartTables(
        KeyedTable(d.spark, work_folder(d, "songs"), schema, ["id"], 8),
        upkeep.history_table(d.spark, work_folder(d, "history"), history.schema),
        upkeep.growth_table(d.spark, work_folder(d, "growth"), 8),
    )
    with measured_broadcasts(d.spark):
        upkeep.upsert_table(stored.songs, songs)
        stored.history.append(d.stored("song_history"))
    for _ in range(2):
        refresh_tables(stored, discovered(d), landed_items(d), d.item_references(), AS_OF, TIERS)
    return stored


@check("refresh_tables", CATALOG_SQL)
def refresh_tables_songs(d):
    changed = F.coalesce(F.col("last_change_at") == F.lit(AS_OF).cast("timestamp_ntz"), F.lit(False))
    return refreshed_tables(d).songs.read().select(
        "id", "title", "created_at", "play_count", "fetch_fail_count", "status", "update_tier", changed.alias("changed")
    )


@check("refresh_tables_history", CATALOG_HISTORY_SQL)
def refresh_tables_history(d):
    return refreshed_tables(d).history.read().select("id", "checked_at", "play_count")


@check(
    "fast_refresh",
    """SELECT id, title, CASE WHEN play_count > 0 AND id IN (SELECT id FROM v_quality_targets) THEN play_count + 10 ELSE play_count
         END AS play_count FROM v_songs""",
)
def fast_refresh(d):
    out = jobs.fast_refresh(d.songs(), d.stored("song_history"), landed_items(d), AS_OF)["songs"]
    return out.select("id", "title", "play_count")


@check(
    "fast_refresh_history",
    """WITH kept AS (SELECT id FROM v_songs WHERE created_at >= TIMESTAMP '2024-01-27')
       SELECT id, checked_at, play_count FROM v_history WHERE id IN (SELECT id FROM kept)
       UNION ALL SELECT id, TIMESTAMP '2024-01-31', play_count + 10 FROM v_quality_targets WHERE play_count > 0""",
)
def fast_refresh_history(d):
    """The run archives expired items, so only the history of the others stays."""
    out = jobs.fast_refresh(
        d.songs(), d.stored("song_history"), landed_items(d), AS_OF, rank_history=d.rank_history(), archive=True
    )["song_history"]
    return out.select("id", "checked_at", "play_count")


@check(
    "catalog_refresh_archive",
    REFRESH_SQL
    + """SELECT id, 'archive' AS kept, CASE WHEN ok THEN play_count + 10 ELSE play_count END::DOUBLE AS play_count,
           NULL::BIGINT AS snapshots FROM u WHERE created_at < TIMESTAMP '2024-01-27'
         UNION ALL SELECT id, 'songs', CASE WHEN ok THEN play_count + 10 ELSE play_count END,
           (SELECT count(*) FROM v_history h WHERE h.id = u.id AND h.checked_at >= TIMESTAMP '2024-01-24')
           + (SELECT count(DISTINCT h.checked_at::DATE) FROM v_history h WHERE h.id = u.id AND h.checked_at < TIMESTAMP '2024-01-24')
           + ok::INT FROM u WHERE created_at IS NULL OR created_at >= TIMESTAMP '2024-01-27'""",
)
def catalog_refresh_archive(d):
    """Refresh with archiving and without a rank history."""
    out = jobs.catalog_refresh(
        d.songs(gaps=True), d.stored("song_history"), discovered(d), landed_items(d), d.item_references(), AS_OF, TIERS,
        archive=True,
    )
    counts = out["song_history"].groupBy("id").agg(F.count(F.lit(1)).alias("snapshots"))
    songs = out["songs"].join(counts, "id", "left").select(
        "id", F.lit("songs").alias("kept"), F.col("play_count").cast("double").alias("play_count"),
        F.coalesce("snapshots", F.lit(0)).alias("snapshots"),
    )
    moved = out["archive"].select(
        "id", F.lit("archive").alias("kept"), F.col("play_count").cast("double").alias("play_count"),
        F.lit(None).cast("long").alias("snapshots"),
    )
    return moved.unionByName(songs)


SHARD_SQL = """
    WITH last AS (SELECT l_partkey, l_quantity FROM lineitem
      QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey DESC, l_orderkey DESC, l_extendedprice DESC) = 1),
    g AS (SELECT p_partkey::VARCHAR AS id, p_name AS title, l_quantity AS play_count,
        CASE WHEN p_size % 2 = 0 THEN TIMESTAMP '2024-01-31' - to_hours(p_size * 4) END AS stored,
        CASE WHEN p_size > 5 THEN TIMESTAMP '2024-01-31' - to_hours(p_size * 4) END AS seen, p_size
      FROM part LEFT JOIN last ON l_partkey = p_partkey),
    m AS (SELECT *, coalesce(stored, seen) AS created_at FROM g),
    k AS (SELECT * FROM m WHERE created_at IS NULL OR created_at >= TIMESTAMP '2024-01-27')
"""


def shard_outputs(d):
    """Catalogue and history of parts, and refresh results of four shards."""
    id_ = F.col("p_partkey").cast("string").alias("id")
    made = F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(hours=F.col("p_size") * 4)
    parts = d.raw("part")
    base = parts.select(id_, F.col("p_name").alias("title"), F.when(F.col("p_size") % 2 == 0, made).alias("created_at"),
                        F.lit(0.0).alias("play_count"))
    hist = parts.where(F.col("p_size") > 5).select(
        id_, (made + F.make_dt_interval(hours=F.lit(1))).alias("checked_at"), made.alias("created_at"), F.lit(1.0).alias("play_count")
    )
    lines = d.raw("lineitem").select(
        F.col("l_partkey").cast("string").alias("id"), F.col("l_quantity").cast("double").alias("play_count"), "l_suppkey",
        "l_orderkey", "l_extendedprice",
    )
    updates = base.drop("play_count").join(lines, "id")
    snapshots = lines.select("id", F.lit(AS_OF).cast("timestamp_ntz").alias("checked_at"), "play_count")
    order = [F.col("l_suppkey"), F.col("l_orderkey"), F.col("l_extendedprice")]
    return jobs.merge_shard_outputs(base, hist, updates, snapshots, order, AS_OF, archive=True)


@check("merge_shards_job", SHARD_SQL + "SELECT id, title, created_at, coalesce(play_count, 0)::DOUBLE AS play_count FROM k")
def merge_shards_job(d):
    return shard_outputs(d)["songs"].select("id", "title", "created_at", F.col("play_count").cast("double").alias("play_count"))


@check(
    "merge_shards_history",
    SHARD_SQL
    + """SELECT k.id, TIMESTAMP '2024-01-31' AS checked_at, l_quantity::DOUBLE AS play_count FROM lineitem JOIN k ON k.id = l_partkey::VARCHAR
         UNION ALL SELECT id, seen + to_hours(1), 1 FROM k WHERE seen IS NOT NULL""",
)
def merge_shards_history(d):
    return shard_outputs(d)["song_history"].select("id", "checked_at", F.col("play_count").cast("double").alias("play_count"))


@check("ingest_aligned", "SELECT page_id::VARCHAR AS page_id, url, '' AS title FROM pages")
def ingest_aligned(d):
    return catalog.stringify(catalog.align_schema(d.raw("pages"), ("page_id", "url", "title")))
