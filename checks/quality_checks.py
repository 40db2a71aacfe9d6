"""Comment storage and quality."""
from __future__ import annotations

from pyspark.sql import functions as F

from chartlake.operators import quality
from chartlake.plans import jobs
from chartlake.sources.driver import AS_OF
from checks.registry import check

# Comments of parts are stored and analysed, those of documents stored only,
# those of conversations newly fetched.
SUMMARY_SQL = """
    SELECT song_id, count(*) AS n, count(*) FILTER (bucket = 'meaningful') AS m, count(*) FILTER (bucket = 'generic') AS g,
           count(*) FILTER (bucket = 'mention_only') AS o, count(*) FILTER (bucket = 'emoji_only') AS e,
           sum(round(quality_weight * 10000)::BIGINT)::BIGINT / 10000.0::DOUBLE AS w,
           greatest(0.0::DOUBLE, least(1.0::DOUBLE, sum(round(quality_weight * 10000)::BIGINT)::BIGINT / 10000.0::DOUBLE / count(*))) AS ratio,
           (SELECT string_agg(quality_label || ':' || k, ', ' ORDER BY k DESC, quality_label)
            FROM (SELECT quality_label, count(*) AS k FROM {src} i WHERE i.song_id = c.song_id GROUP BY 1)) AS labels
    FROM {src} c GROUP BY song_id
"""


def stored(d):
    parts = quality.mark_analyzed(d.part_comments(), AS_OF)
    return parts.unionByName(d.line_comments(), allowMissingColumns=True)


@check(
    "comment_quality_summary",
    f"""WITH q AS ({SUMMARY_SQL.format(src='v_comments')})
        SELECT s.id, coalesce(n, 0) AS analyzed_comment_count, coalesce(m, 0) AS meaningful_count, coalesce(g, 0) AS generic_count,
          coalesce(o, 0) AS mention_only_count, coalesce(e, 0) AS emoji_only_count, round(coalesce(w, 0), 4) AS weighted_quality_sum,
          round(coalesce(ratio, 1), 4) AS comment_quality_ratio,
          round(s.comment_count * coalesce(ratio, 1), 2) AS adjusted_comment_count,
          coalesce(labels, CASE WHEN s.comment_count <= 0 THEN 'no_comments' ELSE 'no_analyzed_comments' END) AS comment_quality_summary
        FROM v_songs s LEFT JOIN q ON q.song_id = s.id""",
)
def comment_quality_summary(d):
    labelled = quality.mark_analyzed(d.comments(), AS_OF)
    return quality.quality_summary(labelled, d.songs()).drop("comment_count")


@check(
    "comments_fetch_needed",
    """WITH n AS (SELECT song_id, count(*) AS k FROM v_comments GROUP BY 1)
       SELECT s.id, s.comment_count, coalesce(n.k, 0) AS stored_count FROM v_songs s LEFT JOIN n ON n.song_id = s.id
       WHERE s.comment_count > 0 AND coalesce(n.k, 0) < s.comment_count""",
)
def comments_fetch_needed(d):
    return quality.fetch_needed(d.songs(), d.comments()).select("id", "comment_count", "stored_count")


@check(
    "comments_unanalyzed",
    "SELECT comment_id, song_id FROM v_comments WHERE part = 'line' AND song_id IN (SELECT id FROM v_songs)",
)
def comments_unanalyzed(d):
    return quality.unanalyzed(stored(d), d.songs()).select("comment_id", "song_id")


@check(
    "comments_upsert",
    """SELECT comment_id, song_id, CASE WHEN part = 'part' THEN quality_label END AS quality_label,
         part = 'chat' AS is_new FROM v_comments WHERE part <> 'chat' OR trim(content, ' \t\n\r') <> ''
       UNION ALL SELECT 'generated_' || sha1(conv_id || '|' || '' || '|' || role || '|' || trim(text, ' \t\n\r')), conv_id::VARCHAR,
         NULL, true FROM conversations WHERE trim(text, ' \t\n\r') <> '' GROUP BY ALL""",
)
def comments_upsert(d):
    nameless = d.raw("conversations").select(
        F.lit("").alias("comment_id"),
        F.col("conv_id").cast("string").alias("song_id"),
        F.col("text").alias("content"),
        F.col("role").alias("user_handle"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"),
    )
    known = d.part_comments()
    fetched = d.chat_comments().unionByName(known).unionByName(nameless, allowMissingColumns=True)
    out = quality.upsert_comments(stored(d), fetched, AS_OF)
    is_new = F.col("fetched_at").isNotNull().alias("is_new")
    return out.select("comment_id", "song_id", "quality_label", is_new)


@check(
    "quality_writeback",
    f"""WITH q AS ({SUMMARY_SQL.format(src='v_comments')}), n AS (SELECT * FROM v_songs s LEFT JOIN q ON q.song_id = s.id
          WHERE s.comment_count > 1)
        SELECT s.id, CASE WHEN n.id IS NULL THEN s.adjusted_comment_count ELSE round(n.comment_count * coalesce(ratio, 1), 2) END
          AS adjusted_comment_count, round(CASE WHEN n.id IS NOT NULL THEN coalesce(ratio, 1) END, 4) AS comment_quality_ratio,
          CASE WHEN n.id IS NOT NULL THEN TIMESTAMP '2024-01-31' END AS comment_quality_checked_at
        FROM v_songs s LEFT JOIN n ON n.id = s.id""",
)
def quality_writeback(d):
    labelled = quality.mark_analyzed(d.comments(), AS_OF)
    summary = quality.quality_summary(labelled, d.songs().where(F.col("comment_count") > 1))
    out = quality.quality_writeback(d.songs(), summary, AS_OF)
    return out.select("id", "adjusted_comment_count", "comment_quality_ratio", "comment_quality_checked_at")


# Comments after the job: stored ones, and those fetched for targets that lack some.
JOB_SQL = f"""
    WITH stored AS (SELECT * FROM v_comments WHERE part <> 'chat'),
      t AS (SELECT id, comment_count FROM v_quality_targets),
      k AS (SELECT song_id, count(*) AS k FROM stored GROUP BY 1),
      need AS (SELECT t.id FROM t LEFT JOIN k ON k.song_id = t.id WHERE comment_count > 0 AND coalesce(k, 0) < comment_count),
      used AS (SELECT * FROM stored UNION ALL SELECT * FROM v_comments WHERE part = 'chat'
               AND song_id IN (SELECT id FROM need) AND trim(content, ' \t\n\r') <> ''),
      q AS ({SUMMARY_SQL.format(src='used')})
"""


@check(
    "comment_quality_job",
    JOB_SQL
    + """SELECT t.id, coalesce(n, 0) AS analyzed_comment_count, round(coalesce(ratio, 1), 4) AS comment_quality_ratio,
          round(t.comment_count * coalesce(ratio, 1), 2) AS adjusted_comment_count,
          coalesce(labels, CASE WHEN t.comment_count <= 0 THEN 'no_comments' ELSE 'no_analyzed_comments' END) AS comment_quality_summary
        FROM t LEFT JOIN q ON q.song_id = t.id""",
)
def comment_quality_job(d):
    return quality_outputs(d)["summary"].select(
        "id", "analyzed_comment_count", "comment_quality_ratio", "adjusted_comment_count", "comment_quality_summary"
    )


def quality_outputs(d):
    return jobs.comment_quality_job(d.songs(), d.stored("song_history"), stored(d), d.chat_comments(), AS_OF)


@check(
    "comment_quality_job_comments",
    JOB_SQL
    + """SELECT comment_id, song_id, CASE WHEN part = 'part' OR song_id IN (SELECT id FROM t) THEN quality_label END AS quality_label,
           part = 'chat' AS is_new FROM used""",
)
def comment_quality_job_comments(d):
    """All comments after the job; those of targets are labelled."""
    out = quality_outputs(d)["comments"]
    return out.select("comment_id", "song_id", "quality_label", F.col("fetched_at").isNotNull().alias("is_new"))


@check(
    "comment_quality_job_songs",
    JOB_SQL
    + """SELECT s.id, CASE WHEN t.id IS NULL THEN s.adjusted_comment_count ELSE round(t.comment_count * coalesce(ratio, 1), 2) END
           AS adjusted_comment_count, round(CASE WHEN t.id IS NOT NULL THEN coalesce(ratio, 1) END, 4) AS comment_quality_ratio
         FROM v_songs s LEFT JOIN t ON t.id = s.id LEFT JOIN q ON q.song_id = t.id""",
)
def comment_quality_job_songs(d):
    return quality_outputs(d)["songs"].select("id", "adjusted_comment_count", "comment_quality_ratio")
