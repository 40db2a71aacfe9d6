"""Domain views as DuckDB SQL over the given tables (see FIXTURES.md)."""

VIEWS = {
    "v_item_events": """
        SELECT event_id, user_id, ts, event_type, bk,
               user_id::VARCHAR || '-' || bk::VARCHAR AS id,
               TIMESTAMP '2023-12-31 00:00:00' + to_days(bk * 2) + to_hours((user_id % 24)::INT) AS created_at
        FROM (SELECT *, floor(date_diff('day', DATE '2023-12-31', ts::DATE) / 2.0)::INT AS bk FROM events)
    """,
    "v_history": """
        SELECT ts AS checked_at, id, 'u' || user_id::VARCHAR AS handle, created_at,
               count(*) FILTER (event_type = 'view') OVER w AS play_count,
               count(*) FILTER (event_type = 'click') OVER w AS upvote_count,
               count(*) FILTER (event_type = 'purchase') OVER w AS comment_count,
               count(*) FILTER (event_type = 'error') OVER w AS flag_count
        FROM v_item_events
        WINDOW w AS (PARTITION BY id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    """,
    "v_bare": """
        SELECT id, user_id, created_at, min(ts) AS first_seen_at, max(ts) AS last_checked_at,
               count(*) FILTER (event_type = 'view') AS play_count,
               count(*) FILTER (event_type = 'click') AS upvote_count,
               count(*) FILTER (event_type = 'purchase') AS comment_count,
               count(*) FILTER (event_type = 'error') AS flag_count,
               max(ts) FILTER (event_type = 'error') AS last_error
        FROM v_item_events GROUP BY id, user_id, created_at
    """,
    "v_songs": """
        SELECT b.id, p.p_name AS title, 'u' || b.user_id::VARCHAR AS handle,
               CASE WHEN comment_count > 0 THEN 'Creator ' || b.user_id::VARCHAR END AS display_name,
               b.user_id::VARCHAR AS user_id, b.created_at, first_seen_at, last_checked_at,
               play_count, upvote_count, comment_count, flag_count,
               flag_count > upvote_count + 1 AS is_contest_clip,
               CASE WHEN comment_count >= 4 THEN 'c-1' ELSE '' END AS contest_ids,
               CASE WHEN flag_count >= 4 THEN 'remix_contest' END AS download_disabled_reason,
               p.p_brand || ', ' || p.p_type AS display_tags, p.p_size * 6.0::DOUBLE AS duration,
               'https://tracks.example.com/song/' || b.id AS song_url,
               CASE WHEN play_count > 0 THEN 'https://cdn.example.com/a/' || b.id || '.mp3' ELSE '' END AS audio_url,
               CASE WHEN upvote_count >= 2 THEN comment_count * 0.5::DOUBLE END AS adjusted_comment_count,
               CASE WHEN flag_count >= 5 THEN 'private' WHEN flag_count = 0 THEN '' ELSE 'active' END AS status,
               flag_count * 3 AS fetch_fail_count,
               CASE WHEN play_count = 1 THEN last_checked_at + to_days(2) END AS next_check_at
        FROM v_bare b LEFT JOIN part p ON p.p_partkey = b.user_id % (SELECT count(*) FROM part)
    """,
    "v_gaps": """
        SELECT s.* REPLACE (CASE WHEN b.last_error = b.last_checked_at THEN NULL ELSE s.created_at END AS created_at)
        FROM v_songs s JOIN v_bare b ON s.id = b.id
    """,
    "v_previous": """
        SELECT id, row_number() OVER (ORDER BY play_count DESC, id) AS current_rank
        FROM v_songs WHERE upvote_count > 0 QUALIFY current_rank <= 200
    """,
    "v_ranked": """
        SELECT s.*, p.current_rank FROM v_songs s LEFT JOIN v_previous p ON s.id = p.id
    """,
    "v_rank_history": """
        SELECT captured_at, id, row_number() OVER (PARTITION BY captured_at ORDER BY trend_score DESC, id) AS rank,
               trend_score, trend_score AS base_score, 0.0::DOUBLE AS growth_score, 0.0::DOUBLE AS freshness_score,
               play_count, upvote_count, comment_count, comment_count::DOUBLE AS adjusted_comment_count
        FROM (SELECT id, date_trunc('hour', checked_at) AS captured_at, max(play_count) AS play_count,
                     max(upvote_count) AS upvote_count, max(comment_count) AS comment_count,
                     round(ln(1 + max(play_count)) + 3 * ln(1 + max(upvote_count)) + 4 * ln(1 + max(comment_count)), 6)
                       AS trend_score
              FROM v_history GROUP BY ALL)
        QUALIFY rank <= 200
    """,
    # Scores of any catalogue are repeated for the two catalogues in use.
    "v_growth": """
        SELECT id, play_velocity, upvote_velocity, comment_velocity FROM (
          SELECT id, n, hours,
                 greatest(0.0, p1 - p0) / nullif(hours, 0) AS play_velocity,
                 greatest(0.0, u1 - u0) / nullif(hours, 0) AS upvote_velocity,
                 greatest(0.0, c1 - c0) / nullif(hours, 0) AS comment_velocity
          FROM (SELECT h.id, count(*) AS n,
                       date_diff('microsecond', min(h.checked_at), max(h.checked_at)) / 3600000000.0 AS hours,
                       arg_min(h.play_count, (h.checked_at, h.play_count + h.upvote_count + h.comment_count))::DOUBLE AS p0, arg_max(h.play_count, (h.checked_at, h.play_count + h.upvote_count + h.comment_count))::DOUBLE AS p1,
                       arg_min(h.upvote_count, (h.checked_at, h.play_count + h.upvote_count + h.comment_count))::DOUBLE AS u0, arg_max(h.upvote_count, (h.checked_at, h.play_count + h.upvote_count + h.comment_count))::DOUBLE AS u1,
                       arg_min(h.comment_count, (h.checked_at, h.play_count + h.upvote_count + h.comment_count))::DOUBLE AS c0, arg_max(h.comment_count, (h.checked_at, h.play_count + h.upvote_count + h.comment_count))::DOUBLE AS c1
                FROM v_history h JOIN v_songs s ON s.id = h.id
                WHERE h.checked_at >= s.created_at + to_hours(3) GROUP BY h.id))
        WHERE n >= 2 AND hours > 0
    """,
    "v_scored": """
        SELECT *, base_score + growth_score + freshness_score AS trend_score FROM (
          SELECT *, pow(freshness, 1.35) * 35.0 AS freshness_score,
                 ln(1 + play_count) + 3 * ln(1 + upvote_count) + 4 * ln(1 + effective_comment_count) AS base_score,
                 growth_score_raw * 1.5 AS growth_score
          FROM (SELECT *, greatest(96.0 - age_hours, 0) / 96.0 AS freshness,
                       greatest(adjusted_comments, 0) AS effective_comment_count,
                       0.4 * ln(1 + play_delta_window) + 2.0 * ln(1 + upvote_delta_window)
                         + 3.0 * ln(1 + comment_delta_window) AS growth_score_raw
                FROM (SELECT s.*, coalesce(s.adjusted_comment_count, s.comment_count)::DOUBLE AS adjusted_comments,
                             greatest(date_diff('microsecond', s.created_at, TIMESTAMP '2024-01-31') / 3600000000.0, 0)
                               AS age_hours,
                             coalesce(g.play_velocity, 0) AS play_velocity_per_hour,
                             coalesce(g.upvote_velocity, 0) AS upvote_velocity_per_hour,
                             coalesce(g.comment_velocity, 0) AS comment_velocity_per_hour,
                             coalesce(g.play_velocity, 0) * 3 AS play_delta_window,
                             coalesce(g.upvote_velocity, 0) * 3 AS upvote_delta_window,
                             coalesce(g.comment_velocity, 0) * 3 AS comment_delta_window
                      FROM v_ranked s LEFT JOIN v_growth g ON s.id = g.id)))
    """,
    "v_active": """
        SELECT * FROM v_scored WHERE created_at >= TIMESTAMP '2024-01-27 00:00:00'
    """,
    "v_chart": """
        SELECT *, row_number() OVER (ORDER BY round(trend_score, 6) DESC, created_at DESC, id) AS rank
        FROM v_active QUALIFY rank <= 200
    """,
    "v_contest_free": """
        SELECT * FROM v_active
        WHERE NOT is_contest_clip AND coalesce(download_disabled_reason, '') <> 'remix_contest' AND contest_ids = ''
    """,
    "v_quality_targets": """
        SELECT * FROM v_contest_free
    """,
    "v_comment_base": """
        SELECT *, (k % greatest((SELECT count(*) FROM customer) // 10, 1))::VARCHAR || '-' || (k % 16)::VARCHAR AS song_id,
               TIMESTAMP '2024-01-31' - to_minutes(k) AS created_at
        FROM (
          SELECT 'chat' AS part, 'c-' || conv_id || '-' || turn AS comment_id, text AS content, role AS user_handle,
                 NULL::VARCHAR AS mention, conv_id AS k
          FROM conversations
          UNION ALL
          SELECT 'line', 'd-' || doc_id || '-' || (pos - 1), lines[pos], source, NULL, doc_id
          FROM (SELECT doc_id, source, lines, unnest(range(1, len(lines) + 1)) AS pos
                FROM (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents))
          UNION ALL
          SELECT 'part', 'p-' || p_partkey,
                 CASE WHEN p_size <= 5 THEN p_name WHEN p_size <= 10 THEN p_type WHEN p_size <= 15 THEN 'love ' || p_name
                      WHEN p_size <= 20 THEN 'love the chorus of ' || p_name
                      WHEN p_size <= 25 THEN 'i really love this ' || p_name
                      WHEN p_size <= 30 THEN '🔥🔥🔥' WHEN p_size <= 35 THEN 'hahahaha' WHEN p_size <= 40 THEN '@' || p_brand
                      WHEN p_size <= 43 THEN 'nice' WHEN p_size <= 46 THEN 'https://a.example/' || p_partkey
                      ELSE 'what is this ' || p_name END, 'parts', p_brand, p_partkey
          FROM part)
    """,
    "v_comment_flags": """
        SELECT *, len(tokens) AS n,
               list_has_any(tokens, ['song','track','beat','beats','vocal','vocals','voice','mix','mixing','melody','melodies',
                 'lyrics','lyric','chorus','hook','drop','bass','drums','guitar','piano','synth','sound','sounds','production',
                 'arrangement','vibe','energy','genre','style','flow','rhythm','master','mastering','instrumental','verse',
                 'bridge','intro','outro']) AS music,
               list_has_any(tokens, ['good','great','amazing','awesome','nice','cool','love','loved','enjoy','enjoyed',
                 'beautiful','fire','banger','excellent','perfect','favorite','fav','incredible','wonderful','fantastic',
                 'dope']) AS positive,
               norm = '' OR (NOT regexp_matches(norm, '[\\p{L}\\p{N}]') AND regexp_matches(norm, '[\\p{S}\\p{P}]'))
                 AS symbol_only,
               len(compact) >= 4 AND len(list_distinct(string_split(compact, ''))) <= 2 AS repeated,
               mention IS NOT NULL AND (norm = lower(mention) OR (len(tokens) <= 2 AND array_to_string(tokens, ' ')
                 = array_to_string(regexp_extract_all(lower(mention), '[a-zA-Z0-9가-힣]+'), ' '))) AS named
        FROM (SELECT *, regexp_extract_all(norm, '[a-zA-Z0-9가-힣]+') AS tokens, regexp_replace(norm, '\\s+', '', 'g') AS compact
              FROM (SELECT *, trim(regexp_replace(regexp_replace(lower(content), 'https?://\\S+', '', 'g'), '\\s+', ' ', 'g'))
                      AS norm FROM v_comment_base))
    """,
    "v_comments": """
        SELECT *, CASE quality_label WHEN 'empty' THEN 0 WHEN 'emoji_only' THEN 0 WHEN 'repeated' THEN 0.1
                    WHEN 'mention_only' THEN 0 WHEN 'generic_short' THEN 0.35 WHEN 'too_short' THEN 0.15
                    WHEN 'generic_positive' THEN 0.55 WHEN 'meaningful_music' THEN 1 WHEN 'meaningful_reaction' THEN 0.85
                    WHEN 'meaningful_long' THEN 0.75 ELSE 0.45 END::DOUBLE AS quality_weight,
                  CASE WHEN quality_label LIKE 'meaningful%' THEN 'meaningful' WHEN quality_label = 'mention_only'
                    THEN 'mention_only' WHEN quality_label IN ('emoji_only', 'repeated') THEN 'emoji_only'
                    ELSE 'generic' END AS bucket
        FROM (SELECT *, CASE
                WHEN norm = '' THEN 'empty' WHEN symbol_only THEN 'emoji_only' WHEN repeated THEN 'repeated'
                WHEN named OR (n = 1 AND len(tokens[1]) >= 3 AND NOT music AND NOT positive) THEN 'mention_only'
                WHEN n <= 2 AND (norm IN ('nice','good','cool','fire','wow','great','amazing','awesome','love','liked','dope',
                  'banger','first','lol','ok','yes','no') OR positive) THEN 'generic_short'
                WHEN n <= 2 THEN 'too_short' WHEN n <= 4 AND positive AND NOT music THEN 'generic_positive'
                WHEN music AND n >= 4 THEN 'meaningful_music' WHEN positive AND n >= 5 THEN 'meaningful_reaction'
                WHEN n >= 8 THEN 'meaningful_long' ELSE 'generic' END AS quality_label FROM v_comment_flags)
    """,
    "v_app_songs": """
        SELECT p_partkey::VARCHAR AS id, 'user' || (p_partkey % (SELECT count(*) FROM supplier))::VARCHAR AS uploader_user_id,
               p_name AS title, CASE WHEN p_size > 10 THEN 'Artist ' || p_brand ELSE '' END AS artist_name,
               p_type || ' from ' || p_brand AS description, p_brand || ', ' || p_type AS style_tags,
               CASE WHEN p_size > 45 THEN 'private' ELSE 'public' END AS visibility,
               CASE WHEN p_size BETWEEN 40 AND 45 THEN 'deleted' ELSE 'active' END AS status,
               p_size >= 3 AS comments_enabled, TIMESTAMP '2024-01-31' - to_hours(p_size * 5) AS created_at
        FROM part
    """,
    "v_profiles": """
        SELECT 'user' || s_suppkey::VARCHAR AS user_id, s_name AS display_name,
               'https://cdn.example.com/p/' || s_suppkey::VARCHAR AS avatar_url FROM supplier
    """,
    "v_play_events": """
        SELECT event_id, ((floor(value)::BIGINT * 7 + user_id) % (SELECT count(*) FROM part))::VARCHAR AS song_id,
               'ses-' || user_id::VARCHAR AS session_id, CASE WHEN user_id > 2 THEN 'user' || user_id::VARCHAR END AS user_id,
               floor(value)::BIGINT AS play_seconds, ts AS counted_at, value >= 10 AS counted, value,
               json_extract_string(props, '$.k')::DOUBLE AS k
        FROM events WHERE event_type = 'view'
    """,
    "v_plays": """
        SELECT * FROM v_play_events WHERE len(session_id) >= 6
        QUALIFY row_number() OVER (PARTITION BY song_id, session_id ORDER BY counted_at, event_id) = 1
    """,
    # First of the batches (event_id modulo 3) that has the pair, and there the first by time.
    "v_first_plays": """
        SELECT song_id, session_id, min(counted_at) AS counted_at FROM (
          SELECT *, min(event_id % 3) OVER (PARTITION BY song_id, session_id) AS first FROM v_play_events WHERE len(session_id) >= 6)
        WHERE event_id % 3 = first GROUP BY ALL
    """,
    "v_likes": """
        SELECT song_id, actor_key FROM (
          SELECT ((floor(value)::BIGINT * 7 + user_id) % (SELECT count(*) FROM part))::VARCHAR AS song_id,
                 'user:' || user_id::VARCHAR AS actor_key FROM events WHERE event_type = 'click')
        WHERE len(actor_key) >= 6 GROUP BY ALL HAVING count(*) % 2 = 1
    """,
    "v_app_comments": """
        SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS id,
               ((conv_id * 3 + turn % 2) % (SELECT count(*) FROM part))::VARCHAR AS song_id, role AS user_id, text AS body,
               CASE WHEN role = 'assistant' THEN 'hidden' ELSE 'visible' END AS status,
               TIMESTAMP '2024-01-31' - to_hours(conv_id) - to_minutes(turn) AS created_at
        FROM conversations
    """,
    "v_counters": """
        SELECT s.*, coalesce(p.n, 0) AS play_count, coalesce(l.n, 0) AS like_count, coalesce(c.n, 0) AS comment_count,
               round(ln(1 + coalesce(p.n, 0)) + 3 * ln(1 + coalesce(l.n, 0)) + 4 * ln(1 + coalesce(c.n, 0))
                 + 30 * pow(greatest(0, 1 - greatest(date_diff('microsecond', s.created_at, TIMESTAMP '2024-01-31'), 0)
                     / 604800000000.0), 1.25), 6) AS trend_score
        FROM v_app_songs s
        LEFT JOIN (SELECT song_id, count(*) AS n FROM v_plays GROUP BY 1) p ON p.song_id = s.id
        LEFT JOIN (SELECT song_id, count(*) AS n FROM v_likes GROUP BY 1) l ON l.song_id = s.id
        LEFT JOIN (SELECT song_id, count(*) AS n FROM v_app_comments WHERE status = 'visible' GROUP BY 1) c
          ON c.song_id = s.id
    """,
    "v_playlists": """
        SELECT o_orderkey::VARCHAR AS id, 'user' || o_custkey::VARCHAR AS owner_user_id, o_orderpriority AS name,
               CASE WHEN o_orderstatus = 'P' THEN 'private' ELSE 'public' END AS visibility,
               CASE WHEN o_orderstatus = 'F' THEN 'deleted' ELSE 'active' END AS status, o_orderdate AS updated_at
        FROM orders
    """,
    "v_items": """
        SELECT l_orderkey::VARCHAR AS playlist_id, l_partkey::VARCHAR AS song_id, l_linenumber AS position,
               l_shipdate AS added_at
        FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey
          ORDER BY l_linenumber, l_shipdate, l_suppkey, l_extendedprice) = 1
    """,
    "v_item_refs": """
        SELECT DISTINCT l_suppkey::VARCHAR || '-' || l_linenumber::VARCHAR AS song_id FROM lineitem
    """,
    "v_tiers": """
        SELECT *, CASE
            WHEN status IN ('frozen', 'deleted', 'unavailable', 'private') OR fetch_fail_count >= 10 THEN 'frozen'
            WHEN created_at IS NULL OR created_at >= TIMESTAMP '2024-01-27' THEN 'hot'
            WHEN playlist_ref_count THEN 'playlist' WHEN handle IN ('u3', 'u5', 'u7', 'u11') THEN 'warm'
            ELSE 'cold' END AS tier
        FROM (SELECT s.*, r.song_id IS NOT NULL AS playlist_ref_count
              FROM v_gaps s LEFT JOIN v_item_refs r ON r.song_id = s.id)
    """,
    "v_tier_hours": """
        SELECT *, CASE tier WHEN 'hot' THEN 0 WHEN 'playlist' THEN 24 WHEN 'warm' THEN 6 WHEN 'frozen' THEN 168 ELSE 72 END
                 AS hours FROM v_tiers
    """,
    "v_due": """
        SELECT * FROM v_tier_hours
        WHERE CASE WHEN next_check_at IS NOT NULL THEN next_check_at <= TIMESTAMP '2024-01-31'
                   WHEN last_checked_at IS NULL THEN tier IN ('hot', 'playlist', 'warm')
                   ELSE last_checked_at <= TIMESTAMP '2024-01-31' - to_hours(hours) END
    """,
    "v_selection": """
        SELECT *, row_number() OVER (ORDER BY
            CASE tier WHEN 'hot' THEN 0 WHEN 'playlist' THEN 1 WHEN 'warm' THEN 2 WHEN 'cold' THEN 3 ELSE 4 END,
            created_at IS NULL DESC, last_checked_at IS NULL DESC, last_checked_at ASC NULLS FIRST,
            created_at DESC NULLS FIRST, id) AS refresh_position
        FROM v_due
    """,
    "v_queue": """
        SELECT *, CASE o_orderpriority
            WHEN '1-URGENT' THEN 'https://tracks.example.com/song/' || uuid
            WHEN '2-HIGH' THEN 'https://www.tracks.example.com/s/' || request_id
            WHEN '3-MEDIUM' THEN 'ftp://tracks.example.com/song/' || uuid
            WHEN '5-LOW' THEN 'https://other.example.org/song/' || uuid ELSE '' END AS url
        FROM (SELECT o_orderkey::VARCHAR AS request_id, o_orderdate AS submitted_at, o_orderpriority,
                CASE o_orderstatus WHEN 'F' THEN 'processed' WHEN 'O' THEN 'pending' ELSE 'queued' END AS status,
                md5(o_custkey::VARCHAR) AS h,
                h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS uuid
              FROM orders)
    """,
}
