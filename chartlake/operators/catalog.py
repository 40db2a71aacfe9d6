"""Keyed catalogue maintenance: alignment, upsert, repair, compaction, tiers."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartlake.config import TierConfig
from chartlake.functions.coerce import as_ts, is_blank, plus_hours, strip
from chartlake.functions.text import tier_handle
from chartlake.operators.charts import cutoff, latest_first, ranked
from chartlake.operators.skew import salted_join

# States that are never refreshed quickly again, and the parts of
# an error text that freeze an item at once.
FROZEN_STATES = ("frozen", "deleted", "unavailable", "private")
FATAL_ERRORS = ("404", "not found", "clip_not_found", "private", "deleted")
# Fixed value: refresh order of the tiers.
TIER_PRIORITY = {"hot": 0, "playlist": 1, "warm": 2, "cold": 3, "frozen": 4}


def align_schema(df: DataFrame, columns: Sequence[str], fill: str = "") -> DataFrame:
    """Listed columns in order; absent ones are filled, others dropped."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(fill).alias(c) for c in columns])


def dedupe_columns(df: DataFrame) -> DataFrame:
    """Of columns with the same name keep the last one, at its place."""
    names = df.columns
    unique = df.toDF(*[f"_{i}" for i in range(len(names))])
    last = {name: i for i, name in enumerate(names)}
    return unique.select(*[F.col(f"_{i}").alias(n) for i, n in enumerate(names) if last[n] == i])


def stringify(df: DataFrame) -> DataFrame:
    """All columns as text: nested values as JSON, null and NaN as null."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            c = F.to_json(c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.nanvl(c, F.lit(None).cast(f.dataType)).cast("string")
        else:
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def ingest_required(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Rows whose required columns are filled, with a JSON copy of the whole row."""
    present = [F.col(c).isNotNull() & (F.col(c).cast("string") != "") for c in required]
    return df.where(reduce(Column.__and__, present)).withColumn("raw", F.to_json(F.struct(*df.columns)))


def upsert_by_key(
    base: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None
) -> DataFrame:
    """Update or insert: rows of ``updates`` replace rows of ``base`` with the same key.

    Of updates with one key the first in ``order`` stays; without an order it is the
    row with the smallest hash, so reruns agree.
    """
    first = order or [F.xxhash64(*updates.columns).asc()]
    unique = dedupe_keep(updates, keys, first)
    rest = base.join(unique.select(*keys), list(keys), "left_anti")
    return unique.unionByName(rest, allowMissingColumns=True)


def union_by_name(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def dedupe_keep(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in ``order``; each task keeps one row per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def add_new(db: DataFrame, incoming: DataFrame, order: Sequence[Column], key: str = "id") -> DataFrame:
    """Only items that are not yet in the catalogue; the first of a batch wins."""
    valid = incoming.where(F.coalesce(~F.col(key).isin("", "None", "nan"), F.lit(False)))
    return dedupe_keep(valid, [key], order).join(db.select(key), key, "left_anti")


def merge_shards(base: DataFrame, partials: DataFrame, order: Sequence[Column], key: str = "id") -> DataFrame:
    """Last row per id of all shard outputs, on top of the base."""
    return upsert_by_key(base, partials, [key], [c.desc() for c in order])


def prune_children(children: DataFrame, parents: DataFrame, key: str = "id") -> DataFrame:
    return salted_join(children, parents.select(key), [key], "left_semi")


def history_compact(hist: DataFrame, as_of: str, high_res_days: int = 7) -> DataFrame:
    """Keep recent and undated snapshots; of older ones the last per id and day.

    Of snapshots at one time the one with the larger counters counts as later.
    """
    limit = cutoff(as_of, high_res_days)
    recent = hist.where(F.col("checked_at").isNull() | (F.col("checked_at") >= limit))
    old = hist.where(F.col("checked_at") < limit).withColumn("_day", F.to_date("checked_at"))
    last = dedupe_keep(old, ["id", "_day"], latest_first(old)).drop("_day")
    return recent.unionByName(last)


def history_append(hist: DataFrame, refreshed: DataFrame, as_of: str) -> DataFrame:
    """Snapshot rows of refreshed items appended to the history."""
    columns = ["id", "title", "handle", "created_at", "play_count", "upvote_count", "comment_count", "flag_count"]
    snapshot = refreshed.select(as_ts(as_of).alias("checked_at"), *[c for c in columns if c in refreshed.columns])
    return union_by_name(hist, snapshot)


def changed_counters(new: DataFrame, old: DataFrame, as_of: str) -> DataFrame:
    """``last_change_at`` on any counter change; ``comments_fetch_needed`` on new comments."""
    counters = ("play_count", "upvote_count", "comment_count")
    previous = old.select(
        "id",
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_old_{c}") for c in counters],
        F.col("last_change_at").alias("_old_change"),
        F.col("comments_fetch_needed").alias("_old_needed"),
    )
    out = new.join(previous, "id", "left")

    def now(c):
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0))

    def before(c):
        return F.coalesce(f"_old_{c}", F.lit(0.0))

    changed = reduce(Column.__or__, [now(c) != before(c) for c in counters])
    more = now("comment_count") > before("comment_count")
    return out.withColumns(
        {
            "last_change_at": F.when(changed, as_ts(as_of)).otherwise(F.col("_old_change")),
            "comments_fetch_needed": F.when(more, F.lit(True)).otherwise(F.col("_old_needed")),
        }
    ).drop("_old_change", "_old_needed", *[f"_old_{c}" for c in counters])


def with_playlist_flag(df: DataFrame, playlist_items: DataFrame | None) -> DataFrame:
    if playlist_items is None:
        return df.withColumn("playlist_ref_count", F.lit(False))
    refs = playlist_items.select(F.col("song_id").cast("string").alias("id")).distinct()
    flagged = df.drop("playlist_ref_count").join(refs.withColumn("_ref", F.lit(True)), "id", "left")
    return flagged.withColumn("playlist_ref_count", F.coalesce("_ref", F.lit(False))).drop("_ref")


def tier_of(as_of: str, cfg: TierConfig) -> Column:
    """Tier of a row with status, fetch_fail_count, created_at, playlist_ref_count, handle."""
    state = F.lower(strip(F.coalesce(F.col("status"), F.lit(""))))
    failures = F.coalesce(F.col("fetch_fail_count"), F.lit(0))
    listed = [h.strip().lower().lstrip("@") for h in cfg.warm_handles if h.strip()]
    warm = tier_handle("handle").isin(listed) if listed else F.lit(False)
    return (
        F.when(state.isin(*FROZEN_STATES) | (failures >= cfg.freeze_failures), "frozen")
        .when(F.col("created_at").isNull() | (F.col("created_at") >= cutoff(as_of, cfg.retention_days)), "hot")
        .when(F.col("playlist_ref_count"), "playlist")
        .when(warm, "warm")
        .otherwise("cold")
    )


def tier_hours(tier: Column, cfg: TierConfig) -> Column:
    out = F.lit(float(cfg.cold_hours))
    for name, hours in cfg.hours().items():
        out = F.when(tier == name, F.lit(float(hours))).otherwise(out)
    return out


def next_check(tier: Column, as_of: str, cfg: TierConfig) -> Column:
    """Next check time with failure backoff."""
    failures = F.coalesce(F.col("fetch_fail_count"), F.lit(0))
    base = tier_hours(tier, cfg)
    backed_off = F.greatest(base, F.lit(float(cfg.backoff_hours)))
    hours = (
        F.when(failures >= cfg.freeze_failures, F.lit(float(cfg.frozen_hours)))
        .when((failures >= cfg.backoff_failures) & (tier != "frozen"), backed_off)
        .otherwise(base)
    )
    return plus_hours(as_ts(as_of), hours)


def is_due(tier: Column, as_of: str, cfg: TierConfig) -> Column:
    now = as_ts(as_of)
    by_age = F.col("last_checked_at") <= plus_hours(now, -tier_hours(tier, cfg))
    never = tier.isin("hot", "playlist", "warm")
    return (
        F.when(F.col("next_check_at").isNotNull(), F.col("next_check_at") <= now)
        .when(F.col("last_checked_at").isNull(), never)
        .otherwise(by_age)
    )


def update_tiers(db: DataFrame, playlist_items: DataFrame | None, as_of: str, cfg: TierConfig) -> DataFrame:
    """Tier, default status and next check; a next check in the future is kept."""
    out = with_playlist_flag(db, playlist_items).withColumn("update_tier", tier_of(as_of, cfg))
    planned = F.col("next_check_at")
    return out.withColumns(
        {
            "status": F.when(is_blank("status"), F.lit("active")).otherwise(F.col("status")),
            "next_check_at": F.when(planned > as_ts(as_of), planned).otherwise(
                next_check(F.col("update_tier"), as_of, cfg)
            ),
        }
    )


def due_items(db: DataFrame, playlist_items: DataFrame | None, as_of: str, cfg: TierConfig) -> DataFrame:
    out = with_playlist_flag(db, playlist_items).withColumn("computed_update_tier", tier_of(as_of, cfg))
    return out.where(is_due(F.col("computed_update_tier"), as_of, cfg))


def refresh_order(tier: str = "computed_update_tier") -> list[Column]:
    priority = F.lit(9)
    for name, p in TIER_PRIORITY.items():
        priority = F.when(F.col(tier) == name, F.lit(p)).otherwise(priority)
    return [
        priority.asc(),
        F.col("created_at").isNull().desc(),
        F.col("last_checked_at").isNull().desc(),
        F.col("last_checked_at").asc_nulls_first(),
        F.col("created_at").desc_nulls_first(),
        F.col("id").asc(),
    ]


def refresh_selection(db: DataFrame, playlist_items: DataFrame | None, as_of: str, cfg: TierConfig) -> DataFrame:
    """Due items in refresh order, numbered from 1 (at most ``cfg.max_rows``, if set)."""
    return ranked(due_items(db, playlist_items, as_of, cfg), refresh_order(), cfg.max_rows, "refresh_position")


def shard_assign(selection: DataFrame, shards: int) -> DataFrame:
    """Shard number of an ordered selection: every n-th row."""
    return selection.withColumn("shard", F.pmod(F.col("refresh_position") - 1, F.lit(shards)).cast("int"))


def fetch_failures(
    db: DataFrame, failures: DataFrame, playlist_items: DataFrame | None, as_of: str, cfg: TierConfig
) -> DataFrame:
    """Failed items with their new failure count, error, state, tier and next check.

    ``failures`` has one row (id, error) per failed item.
    """
    failed = db.join(failures.select("id", F.col("error").alias("_error")), "id")
    failed = with_playlist_flag(failed, playlist_items)
    count = F.coalesce(F.col("fetch_fail_count"), F.lit(0)) + 1
    error = F.coalesce(F.nullif(F.col("_error"), F.lit("")), F.lit("fetch_failed"))
    lowered = F.lower(F.coalesce("_error", F.lit("")))
    fatal = reduce(Column.__or__, [F.contains(lowered, F.lit(w)) for w in FATAL_ERRORS])
    failed = failed.withColumns(
        {
            "last_checked_at": as_ts(as_of),
            "fetch_fail_count": count.cast("long"),
            "last_fetch_error": error,
        }
    )
    frozen = (F.col("fetch_fail_count") >= cfg.freeze_failures) | fatal
    kept_tier = F.nullif(F.coalesce(F.col("update_tier"), F.lit("")), F.lit("")) if "update_tier" in db.columns else F.lit(None)
    failed = failed.withColumn("_frozen", frozen).withColumns(
        {
            "update_tier": F.when(F.col("_frozen"), F.lit("frozen")).otherwise(
                F.coalesce(kept_tier, tier_of(as_of, cfg))
            ),
        }
    )
    failed = failed.withColumn(
        "status",
        F.when(F.col("_frozen"), F.lit("frozen")).otherwise(
            F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("active"))
        ),
    )
    return failed.withColumn("next_check_at", next_check(F.col("update_tier"), as_of, cfg)).drop("_error", "_frozen")


