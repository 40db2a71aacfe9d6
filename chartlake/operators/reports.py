"""Row counts, completeness, repair and payload reports."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartlake.config import ChartConfig, RankingConfig
from chartlake.functions.coerce import as_ts, display_time, iso_or_blank, strip
from chartlake.functions.text import clean_text
from chartlake.operators.catalog import union_by_name
from chartlake.operators.charts import chart_candidates, cutoff
from chartlake.operators.scoring import restore_created_at

# Texts that count as missing in the completeness report.
MISSING_TOKENS = ("", "nan", "none", "null", "<na>", "-")


# Fixed values of the serving document.
DOCUMENT_VERSION = 2
TOP_RULE = "score every active DB song, sort by trend_score desc, then created_at desc, then id, then take top N"
TABS_ORDER = ("new_songs", "top200", "crew")
RANKING_FACTS = (
    "play_weight", "like_weight", "comment_weight", "growth_weight", "freshness_weight", "freshness_power",
    "growth_window_hours",
)


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    return union_by_name(
        *[df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, df in tables.items()]
    )


def _unpivot(row: DataFrame, columns: Sequence[str], name: str, value: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in columns])
    keep = [c for c in row.columns if c not in columns]
    return row.select(*keep, F.explode(pairs).alias("_p")).select(f"_p.{name}", f"_p.{value}", *keep)


def completeness_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Filled values per column, in one pass."""
    filled = [
        F.count_if(~F.lower(strip(F.coalesce(F.col(c).cast("string"), F.lit("")))).isin(*MISSING_TOKENS)).alias(c)
        for c in columns
    ]
    return _unpivot(df.agg(*filled, F.count(F.lit(1)).alias("total_rows")), columns, "column_name", "valid_rows")


def text_repair_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per column that text cleaning would change, in one pass."""
    cleaned = df.select(*columns).withColumns({f"_c_{c}": clean_text(c) for c in columns})
    changed = [
        F.count_if(F.col(f"_c_{c}") != strip(F.coalesce(F.col(c), F.lit("")))).alias(c) for c in columns
    ]
    return _unpivot(cleaned.agg(*changed), columns, "column_name", "changed_rows")


def restore_report(db: DataFrame, hist: DataFrame) -> DataFrame:
    """Valid creation times before and after the repair."""
    before = F.col("created_at").isNotNull()
    marked = restore_created_at(db.withColumn("_before", before), hist)
    return marked.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if("_before").alias("valid_before"),
        F.count_if(F.col("created_at").isNotNull()).alias("valid_after"),
    ).withColumn("restored", F.col("valid_after") - F.col("valid_before"))


def tier_counts(db: DataFrame, tier: str = "update_tier") -> DataFrame:
    return db.groupBy(tier).agg(F.count(F.lit(1)).alias("row_count"))


def payload_meta(
    db: DataFrame,
    hist: DataFrame,
    as_of: str,
    ranking: RankingConfig = RankingConfig(),
    cfg: ChartConfig = ChartConfig(),
) -> DataFrame:
    """One row of document facts: version, rules, weights, counts, newest times, cutoff."""
    max_age_days = ranking.max_age_days
    songs = db.agg(
        F.count(F.lit(1)).alias("db_song_count"),
        F.max("created_at").alias("_created"),
        F.max("last_checked_at").alias("_checked"),
    )
    active = chart_candidates(db, as_of, max_age_days).agg(F.count(F.lit(1)).alias("active_song_count"))
    snapshots = hist.agg(F.count(F.lit(1)).alias("history_row_count"))
    row = songs.crossJoin(F.broadcast(active)).crossJoin(F.broadcast(snapshots))
    return row.select(
        display_time(as_ts(as_of)).alias("generated_at"),
        "active_song_count",
        "db_song_count",
        "history_row_count",
        display_time("_created").alias("newest_created_at"),
        display_time("_checked").alias("last_checked_at"),
        iso_or_blank(cutoff(as_of, max_age_days)).alias("cutoff_utc"),
        F.lit(DOCUMENT_VERSION).alias("version"),
        F.lit(f"valid created_at >= generated_at - {max_age_days} days").alias("candidate_rule"),
        F.lit(TOP_RULE).alias("top200_rule"),
        F.lit(max_age_days).alias("max_age_days"),
        F.lit(cfg.top_n).alias("top_n"),
        F.struct(*[F.lit(getattr(ranking, n)).alias(n) for n in RANKING_FACTS]).alias("ranking"),
        F.array(*[F.lit(t) for t in TABS_ORDER]).alias("tabs_order"),
    )
