"""Headline queries on the given tables; prints one JSON line.

Every query is run once to warm up and once timed, into a sink that discards rows.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from chartlake import build_session  # noqa: E402
from chartlake.session import drop_stages  # noqa: E402
from checks import QUERIES  # noqa: E402

HEADLINE = (
    "trend_chart_topn", "score_songs", "growth_features", "rank_movement", "outlier_flags", "global_rank",
    "history_points", "history_compact", "rank_history_summary", "archive_expired", "update_tiers", "refresh_selection",
    "record_flatten", "text_repair", "comment_classify", "comment_quality_summary", "comments_flatten",
    "song_counters", "app_song_stats", "community_tabs", "playlist_counts", "playlist_songs", "app_payload",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", cpus, 8)
    times = {}
    for name in names:
        for _ in range(2):
            start = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - start, 3)
    drop_stages(spark)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
