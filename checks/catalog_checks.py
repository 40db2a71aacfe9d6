"""Catalogue maintenance, archive, queue and refresh jobs."""
from __future__ import annotations

from pyspark.sql import functions as F

from chartlake.config import TierConfig
from chartlake.operators import archive, catalog, media, reports
from chartlake.plans import jobs, upkeep
from chartlake.sources.driver import AS_OF, ITEM_PREFIX
from chartlake.sources.parts import KeyedTable
from checks.ingest_checks import work_folder
from checks.registry import check

TIERS = TierConfig(warm_handles=("@U3", "u5", "u7", "u11"))


@check("align_schema", "SELECT id, title, '' AS lyrics, handle, '' AS prompt FROM v_songs")
def align_schema(d):
    return catalog.align_schema(d.songs(), ("id", "title", "lyrics", "handle", "prompt"))


@check("dedupe_columns", "SELECT id, upper(title) AS title, id AS handle FROM v_songs")
def dedupe_columns(d):
    songs = d.songs().select("id", "title", "handle")
    doubled = songs.select("id", "title", F.upper("title").alias("title"), "handle", F.col("id").alias("handle"))
    return catalog.dedupe_columns(doubled)


@check(
    "stringify_record",
    """SELECT p_partkey::VARCHAR AS p_partkey, p_name, '["' || p_brand || '","' || p_type || '"]' AS tags,
         '{"size":' || p_size || '}' AS facts, CASE WHEN p_size > 10 THEN p_size::VARCHAR END AS size FROM part""",
)
def stringify_record(d):
    df = d.raw("part").select(
        "p_partkey",
        "p_name",
        F.array("p_brand", "p_type").alias("tags"),
        F.struct(F.col("p_size").alias("size")).alias("facts"),
        F.when(F.col("p_size") > 10, F.col("p_size")).alias("size"),
    )
    return catalog.stringify(df)


@check(
    "ingest_required_raw",
    """SELECT c_name, c_mktsegment, '{"c_name":"' || c_name || '","c_mktsegment":"' || c_mktsegment || '"}' AS raw
       FROM customer WHERE c_acctbal > 0 AND c_mktsegment <> 'MACHINERY'""",
)
def ingest_required_raw(d):
    rows = d.raw("customer").select(
        F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("c_name"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
    )
    return catalog.ingest_required(rows, ("c_name", "c_mktsegment"))


@check(
    "upsert_by_key",
    """SELECT id, title, CASE WHEN created_at >= TIMESTAMP '2024-01-20' THEN play_count + 5 ELSE play_count END AS play_count FROM v_songs
       UNION ALL SELECT 'new-' || p_partkey, p_name, p_size FROM part""",
)
def upsert_by_key(d):
    base = d.songs().select("id", "title", "play_count")
    changed = d.songs().where(F.col("created_at") >= "2024-01-20").select("id", "title", (F.col("play_count") + 5).alias("play_count"))
    added = d.raw("part").select(
        F.concat(F.lit("new-"), F.col("p_partkey").cast("string")).alias("id"),
        F.col("p_name").alias("title"),
        F.col("p_size").cast("long").alias("play_count"),
    )
    return catalog.upsert_by_key(base, changed.unionByName(added), ["id"])


@check(
    "upsert_table",
    """SELECT id, title, CASE WHEN created_at >= TIMESTAMP '2024-01-20' THEN play_count + 5 ELSE play_count END AS play_count FROM v_songs
       UNION ALL SELECT 'new-' || p_partkey, p_name, p_size FROM part""",
)
def upsert_table(d):
    """The same upsert into a stored table, in two changes that rewrite their buckets only."""
    base = d.songs().select("id", "title", "play_count")
    table = KeyedTable(d.spark, work_folder(d, "catalogue"), base.schema, ["id"])
    upkeep.upsert_table(table, base)
    changed = d.songs().where(F.col("created_at") >= "2024-01-20").select("id", "title", (F.col("play_count") + 5).alias("play_count"))
    upkeep.upsert_table(table, changed)
    added = d.raw("part").select(
        F.concat(F.lit("new-"), F.col("p_partkey").cast("string")).alias("id"),
        F.col("p_name").alias("title"),
        F.col("p_size").cast("long").alias("play_count"),
    )
    upkeep.upsert_table(table, added)
    return table.read()


@check(
    "union_by_name",
    "SELECT id, title, NULL AS display_name FROM v_songs UNION ALL SELECT user_id, NULL, display_name FROM v_profiles",
)
def union_by_name(d):
    profiles = d.profiles().select(F.col("user_id").alias("id"), "display_name")
    return catalog.union_by_name(d.songs().select("id", "title"), profiles)


@check(
    "add_new_songs",
    """SELECT id, title FROM (SELECT 'i' || l_partkey AS id, l_orderkey || '/' || l_suppkey AS title, l_orderkey, l_suppkey, l_extendedprice
         FROM lineitem) WHERE id NOT IN (SELECT 'i' || p_partkey FROM part WHERE p_size > 25)
       QUALIFY row_number() OVER (PARTITION BY id ORDER BY l_orderkey, l_suppkey, l_extendedprice) = 1""",
)
def add_new_songs(d):
    known = d.raw("part").where(F.col("p_size") > 25).select(F.concat(F.lit("i"), F.col("p_partkey").cast("string")).alias("id"))
    key, order = F.col("l_partkey").cast("string"), F.col("l_orderkey").cast("string")
    incoming = d.raw("lineitem").select(
        F.concat(F.lit("i"), key).alias("id"),
        F.concat(order, F.lit("/"), F.col("l_suppkey").cast("string")).alias("title"),
        "l_orderkey",
        "l_suppkey",
        "l_extendedprice",
    )
    rank = [F.col("l_orderkey"), F.col("l_suppkey"), F.col("l_extendedprice")]
    return catalog.add_new(known, incoming, rank).select("id", "title")


@check(
    "merge_shards",
    """WITH last AS (SELECT l_partkey, l_suppkey, l_quantity FROM lineitem
         QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey DESC, l_orderkey DESC, l_extendedprice DESC) = 1)
       SELECT p_partkey AS id, coalesce(l_quantity, p_size)::DOUBLE AS play_count FROM part LEFT JOIN last ON l_partkey = p_partkey""",
)
def merge_shards(d):
    base = d.raw("part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("play_count"))
    lines = d.raw("lineitem")
    partials = lines.select(
        F.col("l_partkey").alias("id"), F.col("l_quantity").alias("play_count"), "l_suppkey", "l_orderkey", "l_extendedprice"
    )
    order = [F.col("l_suppkey"), F.col("l_orderkey"), F.col("l_extendedprice")]
    return catalog.merge_shards(base, partials, order).select("id", "play_count")


@check(
    "dedupe_keep",
    """SELECT l_orderkey, l_partkey, l_linenumber, l_shipdate FROM lineitem
       QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber, l_partkey, l_suppkey) = 1""",
)
def dedupe_keep(d):
    order = [F.col("l_shipdate").desc(), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    out = catalog.dedupe_keep(d.raw("lineitem"), ["l_orderkey"], order)
    return out.select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate")


@check("prune_history", "SELECT id, checked_at FROM v_history WHERE id IN (SELECT id FROM v_songs WHERE play_count > 1)")
def prune_history(d):
    kept = d.songs().where(F.col("play_count") > 1)
    return catalog.prune_children(d.song_history(), kept).select("id", "checked_at")


@check(
    "history_compact",
    """SELECT id, checked_at, play_count FROM v_history WHERE checked_at >= TIMESTAMP '2024-01-24'
       UNION ALL SELECT id, checked_at, play_count FROM (SELECT * FROM v_history WHERE checked_at < TIMESTAMP '2024-01-24'
         QUALIFY row_number() OVER (PARTITION BY id, checked_at::DATE ORDER BY checked_at DESC,
           play_count + upvote_count + comment_count DESC) = 1)""",
)
def history_compact(d):
    return catalog.history_compact(d.song_history(), AS_OF).select("id", "checked_at", "play_count")


@check(
    "history_append",
    """SELECT checked_at, id, NULL AS title, play_count FROM v_history
       UNION ALL SELECT TIMESTAMP '2024-01-31', id, title, play_count FROM v_songs""",
)
def history_append(d):
    return catalog.history_append(d.song_history(), d.songs(), AS_OF).select("checked_at", "id", "title", "play_count")


@check(
    "change_detect",
    """SELECT id, CASE WHEN play_count > 0 OR comment_count > 0 THEN TIMESTAMP '2024-01-31' ELSE TIMESTAMP '2024-01-02' END
         AS last_change_at, comment_count > 0 AS comments_fetch_needed FROM v_songs""",
)
def change_detect(d):
    old = d.songs().withColumns(
        {
            "last_change_at": F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"),
            "comments_fetch_needed": F.lit(False),
        }
    )
    new = d.songs().withColumns(
        {"play_count": F.col("play_count") * 2, "comment_count": F.col("comment_count") + F.col("comment_count")}
    )
    return catalog.changed_counters(new, old, AS_OF).select("id", "last_change_at", "comments_fetch_needed")


@check(
    "update_tiers",
    """SELECT id, tier AS update_tier, CASE WHEN status = '' THEN 'active' ELSE status END AS status, playlist_ref_count,
         CASE WHEN next_check_at > TIMESTAMP '2024-01-31' THEN next_check_at ELSE TIMESTAMP '2024-01-31' + to_hours(
           CASE WHEN fetch_fail_count >= 10 THEN 168 WHEN fetch_fail_count >= 3 AND tier <> 'frozen' THEN greatest(hours, 24)
                ELSE hours END) END AS next_check_at FROM v_tier_hours""",
)
def update_tiers(d):
    out = catalog.update_tiers(d.songs(gaps=True), d.item_references(), AS_OF, TIERS)
    return out.select("id", "update_tier", "status", "playlist_ref_count", "next_check_at")


@check("tier_counts", "SELECT tier AS update_tier, count(*) AS row_count FROM v_tiers GROUP BY 1")
def tier_counts(d):
    return reports.tier_counts(catalog.update_tiers(d.songs(gaps=True), d.item_references(), AS_OF, TIERS))


@check("refresh_selection", "SELECT id, tier AS computed_update_tier, refresh_position FROM v_selection")
def refresh_selection(d):
    out = catalog.refresh_selection(d.songs(gaps=True), d.item_references(), AS_OF, TIERS)
    return out.select("id", "computed_update_tier", "refresh_position")


@check("shard_assign", "SELECT id, ((refresh_position - 1) % 4)::INT AS shard FROM v_selection")
def shard_assign(d):
    selection = catalog.refresh_selection(d.songs(gaps=True), d.item_references(), AS_OF, TIERS)
    return catalog.shard_assign(selection, 4).select("id", "shard")


FAILURE_SQL = """
    SELECT f.*, fetch_fail_count + 1 AS fails, CASE WHEN play_count = 0 THEN 'HTTP 404' WHEN play_count = 1 THEN ''
             ELSE 'timeout' END AS err,
           fetch_fail_count + 1 >= 10 OR play_count = 0 AS froze,
           CASE WHEN status = 'private' OR fetch_fail_count + 1 >= 10 THEN 'frozen'
                WHEN created_at IS NULL OR created_at >= TIMESTAMP '2024-01-27' THEN 'hot' WHEN playlist_ref_count THEN 'playlist'
                WHEN handle IN ('u3', 'u5', 'u7', 'u11') THEN 'warm' ELSE 'cold' END AS t2
    FROM v_tiers f
"""


@check(
    "fetch_failures",
    f"""WITH f AS ({FAILURE_SQL}), g AS (SELECT *, CASE WHEN froze THEN 'frozen' ELSE t2 END AS tier2 FROM f)
        SELECT id, fails AS fetch_fail_count, CASE WHEN err = '' THEN 'fetch_failed' ELSE err END AS last_fetch_error,
          tier2 AS update_tier, CASE WHEN froze THEN 'frozen' WHEN status = '' THEN 'active' ELSE status END AS status,
          TIMESTAMP '2024-01-31' + to_hours(CASE WHEN fails >= 10 THEN 168
            WHEN fails >= 3 AND tier2 <> 'frozen' THEN greatest(CASE tier2 WHEN 'hot' THEN 0 WHEN 'playlist' THEN 24
              WHEN 'warm' THEN 6 ELSE 72 END, 24)
            ELSE CASE tier2 WHEN 'hot' THEN 0 WHEN 'playlist' THEN 24 WHEN 'warm' THEN 6 WHEN 'frozen' THEN 168 ELSE 72 END END)
            AS next_check_at FROM g""",
)
def fetch_failures(d):
    db = d.songs(gaps=True)
    plays = F.col("play_count")
    errors = db.select("id", F.when(plays == 0, "HTTP 404").when(plays == 1, "").otherwise("timeout").alias("error"))
    out = catalog.fetch_failures(db, errors, d.item_references(), AS_OF, TIERS)
    return out.select("id", "fetch_fail_count", "last_fetch_error", "update_tier", "status", "next_check_at")


@check(
    "rank_history_summary",
    """SELECT id, min(rank) AS best_rank_history, arg_min(captured_at, (rank, captured_at)) AS best_rank_at,
         max(trend_score) AS best_trend_score_history, arg_min(captured_at, (-trend_score, captured_at)) AS best_score_at_history,
         min(captured_at) AS first_charted_at, max(captured_at) AS last_charted_at, count(*) FILTER (rank <= 10) AS top10_count,
         count(*) FILTER (rank <= 50) AS top50_count, count(*) FILTER (rank <= 200) AS top200_count, count(rank) AS chart_in_count
       FROM v_rank_history GROUP BY id""",
)
def rank_history_summary(d):
    return archive.rank_history_summary(d.rank_history())


ARCHIVE_SQL = """
    WITH s AS (SELECT id, min(rank) AS r, arg_min(captured_at, (rank, captured_at)) AS rank_at,
        arg_min(captured_at, (-trend_score, captured_at)) AS at, max(trend_score) AS t, min(captured_at) AS first, max(captured_at) AS last,
        count(*) FILTER (rank <= 10) AS n10, count(*) FILTER (rank <= 50) AS n50, count(*) FILTER (rank <= 200) AS n200, count(rank) AS n
      FROM v_rank_history GROUP BY id),
    c AS (SELECT *, row_number() OVER (ORDER BY round(trend_score, 6) DESC NULLS LAST, created_at DESC NULLS LAST, id) AS computed_rank
      FROM v_scored)
"""


def archive_inputs(d):
    """Ranked catalogue, and an archive that already holds played items and items long gone."""
    db = d.ranked_songs().withColumn("best_rank", F.col("current_rank").cast("double"))
    played = d.songs().where(F.col("play_count") > 1).select("id", F.lit("old title").alias("title"))
    gone = d.raw("part").select(F.concat(F.lit("gone-"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("title"))
    return db, archive.archive_layout(played.unionByName(gone))


@check(
    "archive_expired",
    ARCHIVE_SQL
    + """SELECT c.id, coalesce(title, '') AS title, 'older_than_4d' AS archive_reason, TIMESTAMP '2024-01-31' AS archived_at, created_at,
           computed_rank::DOUBLE AS final_rank, round(trend_score, 6) AS final_trend_score, round(base_score, 6) AS final_base_score,
           round(growth_score, 6) AS final_growth_score, round(freshness_score, 6) AS final_freshness_score,
           least(current_rank, computed_rank, s.r)::DOUBLE AS best_rank, rank_at AS best_rank_at, first AS first_charted_at,
           last AS last_charted_at, round(greatest(trend_score, s.t), 6) AS best_trend_score,
           coalesce(s.at, TIMESTAMP '2024-01-31') AS best_score_at, coalesce(n10, 0)::DOUBLE AS top10_count,
           coalesce(n50, 0)::DOUBLE AS top50_count, coalesce(n200, 0)::DOUBLE AS top200_count, coalesce(n, 0)::DOUBLE AS chart_in_count,
           play_count::DOUBLE AS peak_play_count, upvote_count::DOUBLE AS peak_upvote_count, comment_count::DOUBLE AS peak_comment_count,
           adjusted_comment_count::DOUBLE AS peak_adjusted_comment_count
         FROM c LEFT JOIN s ON s.id = c.id WHERE created_at < TIMESTAMP '2024-01-27'
         UNION ALL SELECT id, 'old title', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
           NULL, NULL, NULL, NULL, NULL, NULL FROM v_songs WHERE play_count > 1 AND created_at >= TIMESTAMP '2024-01-27'
         UNION ALL SELECT 'gone-' || p_partkey, p_name, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
           NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM part""",
)
def archive_expired(d):
    db, older = archive_inputs(d)
    out = archive.archive_expired(db, d.stored("song_history"), d.stored("rank_history"), older, AS_OF)["archive"]
    scores = ("final_trend_score", "final_base_score", "final_growth_score", "final_freshness_score", "best_trend_score")
    counts = ("top10_count", "top50_count", "top200_count", "chart_in_count")
    reason = F.nullif("archive_reason", F.lit(""))
    return out.select(
        "id", "title", reason.alias("archive_reason"), "archived_at", "created_at", "final_rank", "best_rank", "best_rank_at",
        "first_charted_at", "last_charted_at", "best_score_at", *[F.round(c, 6).alias(c) for c in scores],
        *[F.col(c).cast("double").alias(c) for c in counts], *[f"peak_{c}" for c in archive.PEAKS],
    )


@check(
    "archive_prune",
    """SELECT 'songs' AS kept, count(*) AS row_count FROM v_songs WHERE created_at >= TIMESTAMP '2024-01-27'
       UNION ALL SELECT 'song_history', count(*) FROM v_history WHERE id IN (SELECT id FROM v_songs WHERE created_at >= TIMESTAMP '2024-01-27')
       UNION ALL SELECT 'rank_history', count(*) FROM v_rank_history WHERE id IN (SELECT id FROM v_songs
         WHERE created_at >= TIMESTAMP '2024-01-27')""",
)
def archive_prune(d):
    db, older = archive_inputs(d)
    moved = archive.archive_expired(db, d.stored("song_history"), d.rank_history(), older, AS_OF)
    kept = {name: moved[name] for name in ("songs", "song_history", "rank_history")}
    return reports.table_counts(kept).withColumnRenamed("table_name", "kept")


QUEUE_SQL = """
    WITH u AS (SELECT q.*, CASE o_orderpriority WHEN '1-URGENT' THEN uuid WHEN '2-HIGH' THEN uuid END AS song,
        status IN ('pending', 'queued') AS done FROM v_queue q),
    f AS (SELECT h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS fid, c_name, c_acctbal, c_mktsegment,
        CASE WHEN c_nationkey <> 0 THEN TIMESTAMP '2024-01-31' - to_hours(c_nationkey * 12)
             WHEN c_mktsegment = 'BUILDING' THEN TIMESTAMP '2024-01-30' END AS created,
        date_diff('hour', created, TIMESTAMP '2024-01-31') / 24.0 AS age
      FROM (SELECT *, md5(c_custkey::VARCHAR) AS h FROM customer)),
    r AS (SELECT u.request_id, u.status, u.song, c_name, done,
        CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'empty url' WHEN o_orderpriority = '3-MEDIUM' THEN 'unsupported scheme'
          WHEN o_orderpriority = '5-LOW' THEN 'host not allowed' WHEN f.fid IS NULL THEN 'failed to fetch item'
          WHEN created IS NULL THEN 'created_at is missing or invalid'
          WHEN age > 4 THEN 'older than 4 days: ' || printf('%.2f', age) ELSE '' END AS err
      FROM u LEFT JOIN f ON f.fid = u.song AND c_acctbal > 0),
    ok AS (SELECT DISTINCT song FROM r WHERE done AND err = '')
"""


def queue_outputs(d):
    """Every pending request; item pages of solvent customers, those of one segment known before."""

    def uuid_of(key):
        digest = F.md5(F.col(key).cast("string"))
        return F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])

    redirects = d.raw("orders").where(F.col("o_orderpriority") == "2-HIGH").select(
        F.concat(F.lit("https://www.tracks.example.com/s/"), F.col("o_orderkey").cast("string")).alias("url"),
        F.concat(F.lit(ITEM_PREFIX), uuid_of("o_custkey")).alias("target"),
    )
    age = F.make_dt_interval(hours=F.col("c_nationkey") * 12)
    created = F.when(F.col("c_nationkey") != 0, F.lit(AS_OF).cast("timestamp_ntz") - age)
    page = F.struct(
        uuid_of("c_custkey").alias("id"), F.col("c_name").alias("title"), F.date_format(created, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at")
    )
    customers = d.raw("customer")
    fetched = customers.select(uuid_of("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, F.to_json(page)).alias("record"))
    known = customers.where(F.col("c_mktsegment") == "BUILDING").select(
        uuid_of("c_custkey").alias("id"), F.lit("old").alias("title"), F.lit(1).cast("long").alias("play_count"),
        F.lit("2024-01-30 00:00:00").cast("timestamp_ntz").alias("created_at"),
    )
    return jobs.queue_run(known, d.song_history(), d.queue(), redirects, fetched, AS_OF)


@check(
    "queue_process",
    QUEUE_SQL
    + """SELECT request_id, CASE WHEN done AND err = '' THEN 'processed' WHEN done THEN 'failed' ELSE status END AS status,
           CASE WHEN done AND err = '' THEN song ELSE '' END AS song_id, CASE WHEN done AND err = '' THEN c_name ELSE '' END AS title,
           CASE WHEN done THEN TIMESTAMP '2024-01-31' END AS processed_at, CASE WHEN done THEN err ELSE '' END AS error FROM r""",
)
def queue_process(d):
    return queue_outputs(d)["queue"].select("request_id", "status", "song_id", "title", "processed_at", "error")


@check(
    "queue_process_songs",
    QUEUE_SQL
    + """SELECT fid AS id, CASE WHEN song IS NULL THEN 'old' ELSE c_name END AS title, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END
           AS play_count, CASE WHEN song IS NULL THEN TIMESTAMP '2024-01-30' ELSE created END AS created_at
         FROM f LEFT JOIN ok ON song = fid WHERE c_mktsegment = 'BUILDING' OR song IS NOT NULL""",
)
def queue_process_songs(d):
    return queue_outputs(d)["songs"].select("id", "title", "play_count", "created_at")


@check(
    "queue_process_history",
    QUEUE_SQL
    + """SELECT id, checked_at, play_count FROM v_history
         UNION ALL SELECT fid, TIMESTAMP '2024-01-31', CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END FROM f JOIN ok ON song = fid""",
)
def queue_process_history(d):
    return queue_outputs(d)["song_history"].select("id", "checked_at", "play_count")


@check(
    "queue_dedupe",
    """SELECT request_id, url FROM v_queue WHERE status = 'processed' AND url <> ''
         AND url NOT IN (SELECT url FROM v_queue WHERE status <> 'processed')""",
)
def queue_dedupe(d):
    queue = d.queue()
    requests = queue.where(F.col("status") == "processed")
    return jobs.queue_dedupe(requests, queue).select("request_id", "url")


def loud_songs(d):
    """Catalogue with earlier loudness results for the items of even plays."""
    url = F.col("audio_url")
    known = F.col("upvote_count") > 0
    return d.ranked_songs().withColumns(
        {
            "loudness_audio_url_hash": F.when(known, F.substring(F.sha2(url, 256), 1, 24)).otherwise(F.lit("")),
            "loudness_status": F.when(F.col("flag_count") > 1, "failed").otherwise("ok"),
            "integrated_lufs": F.when(F.col("comment_count") > 0, F.lit(-20.0)),
            "true_peak_db": F.lit(-3.0),
            "loudness_gain_db": F.lit(2.0),
        }
    )


LOUD_SQL = """SELECT *, audio_url <> '' AND (upvote_count = 0 OR flag_count > 1 OR comment_count = 0) AS needed FROM v_ranked"""


@check("loudness_candidates", f"SELECT id FROM ({LOUD_SQL}) WHERE needed")
def loudness_candidates(d):
    return media.loudness_candidates(loud_songs(d)).select("id")


@check(
    "loudness_priority",
    f"""SELECT id, row_number() OVER (ORDER BY coalesce(current_rank, 999999), created_at DESC, id) AS analysis_position
        FROM ({LOUD_SQL}) WHERE needed""",
)
def loudness_priority(d):
    return media.loudness_priority(loud_songs(d)).select("id", "analysis_position")


def tool_logs(d):
    """Landed measurement logs: two blocks for played items, noise for others."""
    level = F.concat(F.lit("-"), (F.col("play_count") + 8).cast("string"), F.lit(".25"))
    peak = F.concat(F.lit("-"), F.col("upvote_count").cast("string"), F.lit(".5"))

    def block(i, tp):
        return F.concat(
            F.lit('{\n\t"input_i" : "'), i, F.lit('",\n\t"input_tp" : "'), tp,
            F.lit('",\n\t"input_lra" : "5.10",\n\t"input_thresh" : "-30.5",\n\t"target_offset" : "0.1"\n}'),
        )

    good = F.concat(F.lit("size=N/A {x}\n"), block(F.lit("-inf"), F.lit("0.0")), F.lit("\nmore\n"), block(level, peak), F.lit("\nend"))
    return d.songs().select(
        "id",
        F.when(F.col("play_count") > 0, good).otherwise(F.lit("no output")).alias("log"),
        F.when(F.col("play_count") == 0, F.lit("tool\nfailed")).alias("error"),
    )


@check(
    "loudness_log_parse",
    """SELECT id, CASE WHEN play_count > 0 THEN -(play_count + 8.25) END::DOUBLE AS integrated_lufs,
         CASE WHEN play_count > 0 THEN -(upvote_count + 0.5) END::DOUBLE AS true_peak_db,
         CASE WHEN play_count > 0 THEN 5.1 END::DOUBLE AS loudness_input_lra,
         CASE WHEN play_count > 0 THEN -30.5 END::DOUBLE AS loudness_input_thresh,
         CASE WHEN play_count > 0 THEN 0.1 END::DOUBLE AS loudness_target_offset FROM v_songs""",
)
def loudness_log_parse(d):
    return tool_logs(d).select("id", *[c.alias(n) for n, c in media.parse_loudness_log("log").items()])


@check(
    "loudness_update",
    """SELECT id, CASE WHEN play_count > 0 THEN -(play_count + 8.25) END::DOUBLE AS integrated_lufs,
         CASE WHEN play_count > 0 THEN round(least(greatest(least(-14 + play_count + 8.25, -1 + upvote_count + 0.5), -12), 6), 3)
           END::DOUBLE AS loudness_gain_db,
         CASE WHEN play_count > 0 THEN 'ok' ELSE 'failed' END AS loudness_status,
         CASE WHEN play_count > 0 THEN '' ELSE 'tool failed' END AS loudness_error,
         TIMESTAMP '2024-01-31' AS loudness_checked_at, sha256(audio_url)[1:24] AS loudness_audio_url_hash FROM v_songs""",
)
def loudness_update(d):
    out = media.loudness_update(d.songs(), tool_logs(d), AS_OF)
    return out.select(
        "id", "integrated_lufs", "loudness_gain_db", "loudness_status", "loudness_error", "loudness_checked_at",
        "loudness_audio_url_hash",
    )


@check(
    "table_counts",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}"
        for t in ("orders", "lineitem", "events", "documents", "pages", "conversations", "part", "labels")
    ),
)
def table_counts(d):
    names = ("orders", "lineitem", "events", "documents", "pages", "conversations", "part", "labels")
    return reports.table_counts({n: d.raw(n) for n in names})


@check(
    "completeness_report",
    """SELECT column_name, valid_rows, (SELECT count(*) FROM v_gaps) AS total_rows FROM (
         SELECT 'created_at' AS column_name, count(created_at) AS valid_rows FROM v_gaps
         UNION ALL SELECT 'display_name', count(display_name) FROM v_gaps
         UNION ALL SELECT 'audio_url', count(*) FILTER (audio_url <> '') FROM v_gaps
         UNION ALL SELECT 'contest_ids', count(*) FILTER (contest_ids <> '') FROM v_gaps)""",
)
def completeness_report(d):
    return reports.completeness_report(d.songs(gaps=True), ("created_at", "display_name", "audio_url", "contest_ids"))


@check(
    "text_repair_report",
    r"""SELECT 'broken' AS column_name, count(*) FILTER (regexp_matches(text, '[^\x00-\x7F]')) AS changed_rows FROM documents
        UNION ALL SELECT 'plain', 0""",
)
def text_repair_report(d):
    docs = d.raw("documents").select(
        F.decode(F.encode("text", "UTF-8"), "ISO-8859-1").alias("broken"), F.col("text").alias("plain")
    )
    return reports.text_repair_report(docs, ("broken", "plain"))
