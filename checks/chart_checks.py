"""Charts, scores, movement and list views."""
from __future__ import annotations

from pyspark.sql import functions as F

from chartlake.config import ChartConfig, CrewConfig
from chartlake.operators import charts, reports, scoring
from chartlake.operators.ordinal import global_ordinal
from chartlake.plans import upkeep
from chartlake.plans.payload import app_payload, document_songs, serving_rows, song_entries, tab_document
from chartlake.plans.search import SearchTable
from chartlake.sources.driver import AS_OF
from chartlake.sources.tables import document_rows, read_document
from checks.ingest_checks import work_folder
from checks.registry import check

CREW = CrewConfig(handles=("@U3", "u5"), user_ids=("7",), display_names=("creator 11",))
CREW_SQL = "(handle IN ('u3', 'u5') OR user_id = '7' OR lower(coalesce(display_name, '')) = 'creator 11')"
CHART_SQL = """
    SELECT rank, id, title, round(trend_score, 6) AS trend_score, round(base_score, 6) AS base_score,
           round(growth_score, 6) AS growth_score, round(freshness_score, 6) AS freshness_score, created_at
    FROM v_chart
"""


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def counts(*names):
    return [F.col(n).cast("long").alias(n) for n in names]


@check("trend_chart_topn", CHART_SQL)
def trend_chart_topn(d):
    chart = charts.trend_chart(d.songs(gaps=True), d.stored("song_history"), AS_OF)
    return chart.select(
        "rank", "id", "title", *r6("trend_score", "base_score", "growth_score", "freshness_score"), "created_at"
    )


@check(
    "score_songs",
    """SELECT id, round(age_hours, 6) AS age_hours, round(freshness_score, 6) AS freshness_score,
              round(base_score, 6) AS base_score, round(growth_score_raw, 6) AS growth_score_raw,
              round(trend_score, 6) AS trend_score FROM v_scored""",
)
def score_songs(d):
    scored = scoring.score_songs(d.songs(gaps=True), d.stored("song_history"), AS_OF)
    return scored.select(
        "id", *r6("age_hours", "freshness_score", "base_score", "growth_score_raw", "trend_score")
    )


@check(
    "growth_features",
    """SELECT id, round(play_velocity_per_hour, 6) AS play_velocity_per_hour,
              round(upvote_velocity_per_hour, 6) AS upvote_velocity_per_hour,
              round(comment_velocity_per_hour, 6) AS comment_velocity_per_hour,
              round(play_delta_window, 6) AS play_delta_window, round(upvote_delta_window, 6) AS upvote_delta_window,
              round(comment_delta_window, 6) AS comment_delta_window FROM v_scored""",
)
def growth_features(d):
    out = scoring.growth_features(d.songs(), scoring.prepare_history(d.stored("song_history")))
    kinds = [f"{c}_{k}" for c in ("play", "upvote", "comment") for k in ("velocity_per_hour", "delta_window")]
    return out.select("id", *r6(*kinds))


@check(
    "growth_in_batches",
    """SELECT id, round(play_velocity_per_hour, 6) AS play_velocity_per_hour,
              round(upvote_velocity_per_hour, 6) AS upvote_velocity_per_hour,
              round(comment_velocity_per_hour, 6) AS comment_velocity_per_hour FROM v_scored""",
)
def growth_in_batches(d):
    """Growth from the stored state after three batches of snapshots."""
    songs, history = d.songs(), scoring.prepare_history(d.stored("song_history"))
    table = upkeep.growth_table(d.spark, work_folder(d, "growth"))
    for k in range(3):
        upkeep.add_growth(table, songs, history.where(F.pmod(F.xxhash64("checked_at", "id"), F.lit(3)) == k))
    out = scoring.with_growth(songs, table.read())
    return out.select("id", *r6(*[f"{c}_velocity_per_hour" for c in ("play", "upvote", "comment")]))


@check(
    "restore_created_at",
    "SELECT id, s.created_at AS created_at, g.created_at IS NULL AS was_missing FROM v_songs s JOIN v_gaps g USING (id)",
)
def restore_created_at(d):
    db = d.songs(gaps=True).withColumn("was_missing", F.col("created_at").isNull())
    return scoring.restore_created_at(db, d.stored("song_history")).select("id", "created_at", "was_missing")


@check(
    "restore_report",
    """SELECT count(*) AS total_rows, count(created_at) AS valid_before, count(*) AS valid_after,
              count(*) - count(created_at) AS restored FROM v_gaps""",
)
def restore_report(d):
    return reports.restore_report(d.songs(gaps=True), d.stored("song_history"))


@check(
    "prepare_catalog",
    """SELECT id, play_count::DOUBLE AS play_count, flag_count::DOUBLE AS flag_count,
              coalesce(adjusted_comment_count, comment_count)::DOUBLE AS adjusted_comment_count,
              1.0::DOUBLE AS comment_quality_ratio, created_at, song_url FROM v_songs""",
)
def prepare_catalog(d):
    raw = d.songs()
    texts = raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns if c != "song_url"])
    out = scoring.prepare_catalog(texts)
    return out.select(
        "id", "play_count", "flag_count", "adjusted_comment_count", "comment_quality_ratio", "created_at", "song_url"
    )


@check("filter_active", "SELECT id, created_at FROM v_gaps WHERE (created_at IS NULL OR created_at >= TIMESTAMP '2024-01-27')"
       " AND NOT is_contest_clip AND coalesce(download_disabled_reason, '') <> 'remix_contest' AND contest_ids = ''")
def filter_active(d):
    return charts.filter_active(d.songs(gaps=True), AS_OF, 4, hide_contest=True).select("id", "created_at")


@check("chart_candidates", "SELECT id, created_at FROM v_gaps WHERE created_at >= TIMESTAMP '2024-01-27'")
def chart_candidates(d):
    return charts.chart_candidates(d.songs(gaps=True), AS_OF).select("id", "created_at")


@check("crew_filter", f"SELECT id, handle FROM v_songs WHERE {CREW_SQL}")
def crew_filter(d):
    return charts.crew_filter(d.songs(), CREW).select("id", "handle")


@check(
    "outlier_flags",
    """WITH x AS (SELECT id, play_count, upvote_count, comment_count, ln(1 + play_count) AS p, ln(1 + upvote_count) AS u,
                   ln(1 + comment_count) AS c FROM v_songs),
       st AS (SELECT avg(p) AS pm, stddev_pop(p) AS ps, avg(u) AS um, stddev_pop(u) AS us, avg(c) AS cm,
                stddev_pop(c) AS cs FROM x),
       z AS (SELECT x.*, (p - pm) / ps AS play_z, (u - um) / us AS like_z, (c - cm) / cs AS comment_z FROM x, st)
       SELECT id, round(play_z, 6) AS play_zscore, round(like_z, 6) AS like_zscore, round(comment_z, 6) AS comment_zscore,
         play_z >= 2 OR like_z >= 2 OR comment_z >= 2 AS is_outlier,
         concat_ws(' | ', CASE WHEN play_z >= 2 THEN 'play ' || format('{:,}', play_count) || ' / z=' || printf('%.2f', play_z) END,
           CASE WHEN like_z >= 2 THEN 'like ' || format('{:,}', upvote_count) || ' / z=' || printf('%.2f', like_z) END,
           CASE WHEN comment_z >= 2 THEN 'comment ' || format('{:,}', comment_count) || ' / z=' || printf('%.2f', comment_z) END)
           AS outlier_reasons FROM z""",
)
def outlier_flags(d):
    out = scoring.outlier_flags(d.songs(), sigma=2.0)
    return out.select("id", *r6("play_zscore", "like_zscore", "comment_zscore"), "is_outlier", "outlier_reasons")


@check(
    "rank_movement",
    """WITH m AS (SELECT id, rank, current_rank AS prev, trend_score, play_count, effective_comment_count FROM v_chart)
       SELECT s.id, m.rank AS current_rank, m.prev::DOUBLE AS previous_rank, (m.prev - m.rank)::DOUBLE AS rank_change,
         CASE WHEN m.id IS NULL THEN NULL WHEN m.prev IS NULL THEN 'new' WHEN m.prev = m.rank THEN 'same'
              WHEN m.prev > m.rank THEN 'up' ELSE 'down' END AS rank_status,
         round(m.trend_score, 6) AS best_trend_score, m.rank::DOUBLE AS best_rank,
         CASE WHEN m.id IS NOT NULL THEN TIMESTAMP '2024-01-31' END AS best_score_at,
         m.play_count::DOUBLE AS peak_play_count, m.effective_comment_count::DOUBLE AS peak_adjusted_comment_count
       FROM v_songs s LEFT JOIN m ON m.id = s.id""",
)
def rank_movement(d):
    out = charts.rank_movement(d.ranked_songs(), d.stored("song_history"), AS_OF, carry_forward=False)
    return out.select(
        "id", F.col("current_rank").cast("long").alias("current_rank"), "previous_rank", "rank_change", "rank_status",
        *r6("best_trend_score"), "best_rank", "best_score_at", "peak_play_count", "peak_adjusted_comment_count",
    )


@check(
    "rank_movement_carry",
    """WITH old AS (SELECT id, current_rank, current_rank::DOUBLE AS best_rank, CASE WHEN current_rank <= 50
                      THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END AS best, upvote_count * 3.0::DOUBLE AS peak FROM v_ranked),
            m AS (SELECT id, rank, trend_score, upvote_count FROM v_chart)
       SELECT o.id, least(o.best_rank, m.rank::DOUBLE) AS best_rank, round(greatest(o.best, m.trend_score), 6) AS best_trend_score,
         CASE WHEN m.trend_score > o.best THEN TIMESTAMP '2024-01-31' ELSE TIMESTAMP '2024-01-15' END AS best_score_at,
         greatest(o.peak, m.upvote_count::DOUBLE) AS peak_upvote_count
       FROM old o LEFT JOIN m ON m.id = o.id""",
)
def rank_movement_carry(d):
    db = d.ranked_songs().withColumns(
        {
            "best_rank": F.col("current_rank").cast("double"),
            "best_trend_score": F.when(F.col("current_rank") <= 50, F.lit(1000.0)).otherwise(F.lit(1.0)),
            "best_score_at": F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"),
            "peak_upvote_count": F.col("upvote_count") * 3.0,
        }
    )
    out = charts.rank_movement(db, d.stored("song_history"), AS_OF)
    return out.select("id", "best_rank", *r6("best_trend_score"), "best_score_at", "peak_upvote_count")


@check(
    "rank_history_append",
    """SELECT captured_at, id, rank, round(trend_score, 6) AS trend_score, play_count FROM v_rank_history
       WHERE captured_at >= TIMESTAMP '2024-01-26 18:00:00'
       UNION ALL SELECT TIMESTAMP '2024-01-31', id, rank, round(trend_score, 6), play_count FROM v_chart""",
)
def rank_history_append(d):
    ranked = charts.rank_chart(d.ranked_songs(), d.stored("song_history"), AS_OF)
    out = charts.rank_history_append(d.rank_history(), ranked, AS_OF)
    return out.select("captured_at", "id", "rank", *r6("trend_score"), "play_count")


@check(
    "ranked_list",
    """SELECT row_number() OVER (ORDER BY created_at DESC, id) AS rank, id, created_at, NULL::DOUBLE AS current_rank
       FROM v_active QUALIFY rank <= 300""",
)
def ranked_list(d):
    active = charts.chart_candidates(d.ranked_songs(), AS_OF)
    out = charts.clear_movement(charts.ranked_top(active, charts.newest_order(), 300))
    return out.select("rank", "id", "created_at", "current_rank")


@check(
    "global_rank",
    """SELECT id, row_number() OVER (ORDER BY round(trend_score, 6) DESC NULLS LAST, created_at DESC NULLS LAST, id) AS rank
       FROM v_scored""",
)
def global_rank(d):
    scored = scoring.score_songs(d.songs(), d.stored("song_history"), AS_OF).select("id", "trend_score", "created_at")
    return global_ordinal(scored, charts.chart_order(), "rank").select("id", F.col("rank").cast("long").alias("rank"))


@check(
    "history_points",
    """WITH p AS (SELECT id, checked_at, play_count, upvote_count, comment_count FROM v_history
                  WHERE id IN (SELECT id FROM v_chart)
                  QUALIFY row_number() OVER (PARTITION BY id ORDER BY checked_at DESC,
                    play_count + upvote_count + comment_count DESC) <= 5)
       SELECT id, string_agg(strftime(checked_at, '%m-%d %H:%M') || '=' || play_count || '/' || upvote_count || '/'
         || comment_count, ', ' ORDER BY checked_at) AS points FROM p GROUP BY id""",
)
def history_points(d):
    chart = charts.trend_chart(d.songs(), d.stored("song_history"), AS_OF).select("id")
    out = charts.history_points(d.stored("song_history"), F.broadcast(chart), 5)

    def point(p):
        return F.concat(p["checked_at"], F.lit("="), p["play_count"], F.lit("/"), p["upvote_count"], F.lit("/"), p["comment_count"])

    return out.select("id", F.array_join(F.transform("points", point), ", ").alias("points"))


@check(
    "metric_top_in_chart",
    """WITH c AS (SELECT id FROM v_chart WHERE rank <= 20), u AS (
         SELECT 'play_count' AS metric, id, play_count AS metric_value, row_number() OVER (ORDER BY play_count DESC, id) AS rank FROM v_active
         UNION ALL SELECT 'upvote_count', id, upvote_count, row_number() OVER (ORDER BY upvote_count DESC, id) FROM v_active
         UNION ALL SELECT 'comment_count', id, comment_count, row_number() OVER (ORDER BY comment_count DESC, id) FROM v_active)
       SELECT metric, rank, id, metric_value, id IN (SELECT id FROM c) AS in_chart FROM u WHERE rank <= 20""",
)
def metric_top_in_chart(d):
    active = charts.active_scores(d.songs(), d.stored("song_history"), AS_OF)
    chart = charts.ranked_top(active, charts.chart_order(), 20)
    top = charts.top_by_metric(active, chart, ("play_count", "upvote_count", "comment_count"))
    return top.select("metric", "rank", "id", "metric_value", "in_chart")


@check("current_chart", "SELECT id, current_rank FROM v_ranked WHERE current_rank IS NOT NULL")
def current_chart(d):
    return charts.current_chart(d.ranked_songs()).select("id", *counts("current_rank"))


@check(
    "search_songs",
    """SELECT id, title FROM v_songs WHERE contains(lower(concat_ws(' ', coalesce(title, ''), coalesce(display_tags, ''),
         coalesce(display_name, ''), handle, id)), 'gear')""",
)
def search_songs(d):
    return charts.search_songs(d.songs(), " Gear ", ("title", "display_tags", "display_name", "handle", "id")).select(
        "id", "title"
    )


@check(
    "view_sort",
    """WITH l AS (SELECT *, row_number() OVER (ORDER BY play_count DESC, id) AS rank FROM v_active QUALIFY rank <= 300)
       SELECT id, title, row_number() OVER (ORDER BY lower(title) ASC NULLS LAST, rank) AS view_position FROM l
       QUALIFY view_position <= 200""",
)
def view_sort(d):
    active = charts.chart_candidates(d.songs(), AS_OF)
    listed = charts.ranked_top(active, [F.col("play_count").desc(), F.col("id").asc()], 300)
    return charts.view_sort(listed, "title", descending=False, limit=200).select("id", "title", "view_position")


@check(
    "view_sort_natural",
    """WITH l AS (SELECT *, row_number() OVER (ORDER BY play_count DESC, id) AS rank FROM v_active QUALIFY rank <= 300),
         k AS (SELECT l.*, p.p_size, split_part(p.p_type, ' ', 1) AS word FROM l JOIN part p
               ON p.p_partkey = l.user_id::BIGINT % (SELECT count(*) FROM part))
       SELECT id, word || p_size AS label, row_number() OVER (ORDER BY lower(strip_accents(word)) DESC, p_size DESC, rank DESC) AS view_position
       FROM k QUALIFY view_position <= 200""",
)
def view_sort_natural(d):
    """Labels such as économy9 and ECONOMY10: accents and case apart, numbers by value."""
    active = charts.chart_candidates(d.songs(), AS_OF)
    listed = charts.ranked_top(active, [F.col("play_count").desc(), F.col("id").asc()], 300)
    size, word = (F.col("duration") / 6).cast("int"), F.substring_index(F.substring_index("display_tags", ", ", -1), " ", 1)
    plain = F.concat(word, size.cast("string"))
    odd = F.when(F.col("rank") % 2 == 0, F.translate(F.lower(plain), "eo", "éö")).otherwise(F.concat(word, F.lpad(size.cast("string"), 4, "0")))
    out = charts.view_sort(listed.withColumn("label", odd).withColumn("plain", plain), "label", True, 200, "ko_CI_AI")
    return out.select("id", F.col("plain").alias("label"), "view_position")


@check(
    "search_table",
    """SELECT id, title FROM v_songs WHERE contains(lower(concat_ws(' ', coalesce(title, ''), coalesce(display_tags, ''),
         coalesce(display_name, ''), handle, id)), 'gear')""",
)
def search_table(d):
    """The same search over stored items and trigram postings, built in two updates."""
    songs = d.songs().select("id", "title", "display_tags", "display_name", "handle")
    table = SearchTable(d.spark, work_folder(d, "search"), songs.schema, ("title", "display_tags", "display_name", "handle", "id"))
    table.upsert(songs.withColumn("title", F.when(F.xxhash64("id") % 2 == 0, F.col("title")).otherwise("gear of old")))
    table.upsert(songs.where(F.xxhash64("id") % 2 != 0))
    return table.search(" Gear ").select("id", "title")


@check(
    "curate_topk",
    """WITH m AS (SELECT id, created_at, trend_score, round(
           contains(lower(title || ' ' || style_tags || ' ' || description), 'red')::INT
         + contains(lower(title || ' ' || style_tags || ' ' || description), 'gear')::INT
         + contains(lower(title || ' ' || style_tags || ' ' || description), 'economy')::INT
         + trend_score / 100.0, 6) AS match_score FROM v_counters)
       SELECT id, match_score, row_number() OVER (ORDER BY match_score DESC, trend_score DESC, created_at DESC, id) AS position
       FROM m QUALIFY position <= 30""",
)
def curate_topk(d):
    from checks.engagement_checks import counters

    return charts.curate(counters(d), "Red, gear economy", 30).select("id", "match_score", "position")


SCORES = (
    "trend_score", "base_score", "growth_score", "freshness_score", "growth_score_raw", "play_delta_window",
    "upvote_delta_window", "comment_delta_window", "freshness", "age_hours", "effective_comment_count",
)
PAYLOAD_SQL = f"""
    WITH z AS (SELECT *, greatest(
        (ln(1 + play_count) - avg(ln(1 + play_count)) OVER ()) / nullif(stddev_pop(ln(1 + play_count)) OVER (), 0),
        (ln(1 + upvote_count) - avg(ln(1 + upvote_count)) OVER ()) / nullif(stddev_pop(ln(1 + upvote_count)) OVER (), 0),
        (ln(1 + comment_count) - avg(ln(1 + comment_count)) OVER ()) / nullif(stddev_pop(ln(1 + comment_count)) OVER (), 0)) AS worst
      FROM v_active),
    t AS (
      SELECT 'top200' AS part, row_number() OVER (ORDER BY round(trend_score, 6) DESC, created_at DESC, id) AS rank, *
        FROM z QUALIFY rank <= 200
      UNION ALL SELECT 'new_songs', row_number() OVER (ORDER BY created_at DESC, id) AS rank, * FROM z QUALIFY rank <= 300
      UNION ALL SELECT 'crew', row_number() OVER (ORDER BY created_at DESC, id) AS rank, * FROM z WHERE {CREW_SQL} QUALIFY rank <= 300),
    h AS (SELECT id, least(count(*), 80) AS points FROM v_history GROUP BY id)
    SELECT t.part, t.rank, t.id, coalesce(title, 'Untitled') AS title, coalesce(display_name, handle) AS creator, '@' || handle AS handle,
      user_id, strftime(created_at, '%Y-%m-%d %H:%M UTC') AS created_at, strftime(created_at, '%Y-%m-%dT%H:%M:%S+00:00') AS created_at_raw,
      coalesce(display_tags, '') AS style_tags, play_count, upvote_count, comment_count,
      {", ".join(f"round({n}, 6) AS {n}" for n in SCORES)}, adjusted_comments AS adjusted_comment_count,
      1.0::DOUBLE AS comment_quality_ratio, coalesce(worst >= 6, false) AS is_outlier, coalesce(worst >= 6, false) AS has_reason,
      song_url, audio_url, '' AS image_url, '' AS rank_status, '' AS loudness_status, '' AS lyrics, NULL::DOUBLE AS rank_change,
      NULL::DOUBLE AS previous_rank, CASE WHEN part = 'top200' THEN current_rank END::DOUBLE AS current_rank_saved,
      NULL::DOUBLE AS integrated_lufs, NULL::DOUBLE AS true_peak_db, NULL::DOUBLE AS loudness_gain_db,
      -14.0::DOUBLE AS loudness_target_lufs, -1.0::DOUBLE AS loudness_true_peak_ceiling_db, h.points
    FROM t JOIN h USING (id)
"""


@check("app_payload", PAYLOAD_SQL)
def payload(d):
    """Every served field of every list, and the number of history points."""
    parts = app_payload(d.ranked_songs(), d.stored("song_history"), AS_OF, CREW)
    rows = parts.select("part", F.explode("document.songs").alias("s"), F.col("document.histories").alias("h"))
    points = F.size(F.try_element_at("h", F.col("s.id"))).cast("long").alias("points")
    flat = rows.select("part", "s.*", points)
    flat = flat.withColumns({c: F.round(c, 6) for c in SCORES})
    return flat.withColumn("has_reason", F.col("outlier_reasons") != "").drop("outlier_reasons")


@check(
    "payload_roundtrip",
    """SELECT 'top200' AS part, rank, id, created_at, round(trend_score, 6) AS trend_score FROM v_chart""",
)
def payload_roundtrip(d):

    chart = charts.trend_chart(d.ranked_songs(), d.stored("song_history"), AS_OF)
    document = tab_document("top200", chart, d.stored("song_history"), ChartConfig(history_points=3))
    back = read_document(document_rows(document), document.schema["document"].dataType)
    songs = document_songs(back)
    return songs.select("part", "rank", "id", "created_at", *r6("trend_score"))


@check(
    "serving_rows",
    """SELECT 'latest' AS key, 'top200' AS part, count(*) AS song_count, NULL AS cutoff_utc FROM v_chart
       UNION ALL SELECT 'latest', 'meta', NULL, '2024-01-27T00:00:00+00:00'""",
)
def stored_rows(d):
    chart = charts.trend_chart(d.ranked_songs(), d.stored("song_history"), AS_OF)
    document = tab_document("top200", chart, d.stored("song_history"), ChartConfig(history_points=3))
    rows = serving_rows(document, reports.payload_meta(d.songs(), d.stored("song_history"), AS_OF))
    text = F.col("payload_json")
    return rows.select(
        "key",
        "part",
        F.get_json_object(text, "$.count").cast("long").alias("song_count"),
        F.get_json_object(text, "$.cutoff_utc").alias("cutoff_utc"),
    )


@check(
    "creator_display",
    """SELECT id, coalesce(display_name, handle) AS creator, '@' || handle AS handle,
              strftime(created_at, '%Y-%m-%dT%H:%M:%S+00:00') AS created_at_raw FROM v_songs""",
)
def creator_display(d):
    ranked = d.songs().withColumn("rank", F.lit(0))
    return song_entries(ranked).select("id", "creator", "handle", "created_at_raw")


@check(
    "payload_meta",
    """SELECT '2024-01-31 00:00 UTC' AS generated_at,
         (SELECT count(*) FROM v_gaps WHERE created_at >= TIMESTAMP '2024-01-27') AS active_song_count,
         count(*) AS db_song_count, (SELECT count(*) FROM v_history) AS history_row_count,
         strftime(max(created_at), '%Y-%m-%d %H:%M UTC') AS newest_created_at,
         strftime(max(last_checked_at), '%Y-%m-%d %H:%M UTC') AS last_checked_at,
         '2024-01-27T00:00:00+00:00' AS cutoff_utc, 2 AS version, 'valid created_at >= generated_at - 4 days' AS candidate_rule,
         'score every active DB song, sort by trend_score desc, then created_at desc, then id, then take top N' AS top200_rule,
         4 AS max_age_days, 200 AS top_n, 'new_songs,top200,crew' AS tabs_order,
         '{"play_weight":1.0,"like_weight":3.0,"comment_weight":4.0,"growth_weight":1.5,"freshness_weight":35.0,'
           || '"freshness_power":1.35,"growth_window_hours":3}' AS ranking FROM v_gaps""",
)
def payload_meta(d):
    meta = reports.payload_meta(d.songs(gaps=True), d.stored("song_history"), AS_OF)
    return meta.withColumn("ranking", F.to_json("ranking")).withColumn("tabs_order", F.array_join("tabs_order", ","))
