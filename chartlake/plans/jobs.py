"""Composite jobs: catalogue refresh, queue, comment quality, fast refresh."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartlake.config import LinkConfig, QualityConfig, RankingConfig, TierConfig
from chartlake.functions.coerce import as_ts, hours_between, is_blank
from chartlake.functions.text import link_error, link_item_id, normalize_text_columns
from chartlake.operators import archive as archiving
from chartlake.operators.catalog import (
    add_new,
    changed_counters,
    fetch_failures,
    history_append,
    history_compact,
    merge_shards,
    prune_children,
    refresh_selection,
    update_tiers,
    upsert_by_key,
)
from chartlake.operators.charts import active_scores, chart_order, filter_active, ranked_top
from chartlake.operators.quality import (
    fetch_needed,
    mark_analyzed,
    quality_summary,
    quality_writeback,
    unseen_comments,
)
from chartlake.operators.scoring import prepare_history, restore_created_at, restored_catalog
from chartlake.operators.skew import salted_join
from chartlake.session import materialize
from chartlake.sources.feeds import flatten_records

PENDING_STATES = ("", "pending", "queued")


def new_item_rows(db: DataFrame, feed: DataFrame, as_of: str, links: LinkConfig = LinkConfig()) -> DataFrame:
    """Catalogue rows of feed items that are not in the catalogue yet."""
    order = [F.col("page_id").asc(), F.col("item_position").asc()]
    unseen = add_new(db, feed.select("id", "record", "page_id", "item_position"), order)
    return flatten_records(unseen, None, as_of, "new_items", links)


def refreshed_rows(targets: DataFrame, fetched: DataFrame, as_of: str, links: LinkConfig = LinkConfig()) -> DataFrame:
    """New catalogue rows of fetched targets (id, record), with change marks."""
    ready = targets
    for name, kind in (("last_change_at", "timestamp_ntz"), ("comments_fetch_needed", "boolean")):
        if name not in ready.columns:
            ready = ready.withColumn(name, F.lit(None).cast(kind))
    wanted = fetched.join(ready.select("id"), "id", "left_semi")
    rows = flatten_records(wanted, ready, as_of, "item_page", links)
    return changed_counters(rows.drop("last_change_at", "comments_fetch_needed"), ready, as_of)


def refresh_changes(
    db: DataFrame, hist: DataFrame, feed: DataFrame, fetched: DataFrame, playlist_items: DataFrame | None, as_of: str,
    tiers: TierConfig = TierConfig(), links: LinkConfig = LinkConfig(),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The catalogue with new items, the refreshed rows, and all rows to upsert (refreshed and failed).

    The catalogue with the new items, the selection and its refreshed rows are each used
    several times, so they are written once.
    """
    known = db.unionByName(new_item_rows(db, feed, as_of, links), allowMissingColumns=True)
    known = materialize(restore_created_at(known, prepare_history(hist)))
    selected = refresh_selection(known, playlist_items, as_of, tiers)
    targets = materialize(selected.drop("refresh_position", "computed_update_tier"))
    landed = fetched.join(targets.select("id"), "id", "left_semi")
    usable = F.col("record").isNotNull()
    ok = materialize(refreshed_rows(targets, landed.where(usable).select("id", "record"), as_of, links))
    failed = fetch_failures(targets, landed.where(~usable).select("id", "error"), playlist_items, as_of, tiers)
    return known, ok, ok.unionByName(failed, allowMissingColumns=True)


def catalog_refresh(
    db: DataFrame,
    hist: DataFrame,
    feed: DataFrame,
    fetched: DataFrame,
    playlist_items: DataFrame | None,
    as_of: str,
    tiers: TierConfig = TierConfig(),
    links: LinkConfig = LinkConfig(),
    rank_history: DataFrame | None = None,
    archive: bool = False,
    ranking: RankingConfig = RankingConfig(),
) -> dict[str, DataFrame]:
    """One refresh run from landed fetch results.

    ``feed`` holds discovered items, ``fetched`` (id, record, error) the landed
    detail pages; a selected item without a usable record counts as failed, one
    without any landed row is left for the next run.
    """
    known, ok, updates = refresh_changes(db, hist, feed, fetched, playlist_items, as_of, tiers, links)
    # Creation times need no second repair: the history has not changed, and
    # refreshed rows keep the repaired value where a record lacks one.
    songs = upsert_by_key(known, updates, ["id"])
    out = finish_run(songs, hist, ok, as_of, rank_history, archive, ranking)
    out["songs"] = update_tiers(out["songs"], playlist_items, as_of, tiers)
    out["song_history"] = history_compact(out["song_history"], as_of)
    return out


def finish_run(
    songs: DataFrame,
    hist: DataFrame,
    refreshed: DataFrame,
    as_of: str,
    rank_history: DataFrame | None = None,
    archive: bool = False,
    ranking: RankingConfig = RankingConfig(),
    archived: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """End of every run that changes the catalogue.

    Optionally archives expired items, cleans the texts, and appends the snapshots of
    refreshed items to the history of those that stay.
    """
    out: dict[str, DataFrame] = {}
    if archive:
        songs = materialize(songs)
        moved = archiving.archive_expired(songs, hist, rank_history, archived, as_of, ranking)
        out = {k: v for k, v in moved.items() if k in ("archive", "rank_history")}
        songs = moved["songs"]
    out["songs"] = normalize_text_columns(songs)
    grown = history_append(hist, refreshed, as_of)
    out["song_history"] = normalize_text_columns(prune_children(grown, songs), ("title", "handle"))
    return out


def fast_refresh(
    db: DataFrame,
    hist: DataFrame,
    fetched: DataFrame,
    as_of: str,
    ranking: RankingConfig = RankingConfig(),
    n: int | None = None,
    links: LinkConfig = LinkConfig(),
    rank_history: DataFrame | None = None,
    archive: bool = False,
) -> dict[str, DataFrame]:
    """Refresh only active items (contest items excluded), or the first ``n`` of their chart."""
    members = materialize(db.join(quality_targets(db, hist, as_of, ranking, n).select("id"), "id", "left_semi"))
    pages = fetched.where(F.col("record").isNotNull()).select("id", "record")
    ok = materialize(refreshed_rows(members, pages, as_of, links))
    return finish_run(upsert_by_key(db, ok, ["id"]), hist, ok, as_of, rank_history, archive, ranking)


def merge_shard_outputs(
    db: DataFrame,
    hist: DataFrame,
    updates: DataFrame,
    snapshots: DataFrame,
    order: Sequence[Column],
    as_of: str,
    rank_history: DataFrame | None = None,
    archive: bool = False,
    ranking: RankingConfig = RankingConfig(),
) -> dict[str, DataFrame]:
    """Outputs of parallel refresh shards on top of the catalogue and its history.

    Of updates of one item the last in ``order`` counts; missing creation times are
    repaired from all snapshots before items are archived.
    """
    grown = hist.unionByName(snapshots, allowMissingColumns=True)
    songs = restore_created_at(merge_shards(db, updates, order), prepare_history(grown))
    return finish_run(songs, grown, updates.limit(0), as_of, rank_history, archive, ranking)


def resolved_requests(queue: DataFrame, redirects: DataFrame, max_items: int | None = None) -> DataFrame:
    """Pending requests with the item id (``_id``) their link or its redirect names."""
    pending = queue.where(F.lower(F.trim(F.coalesce("status", F.lit("")))).isin(*PENDING_STATES))
    if max_items is not None:
        first = [F.col("submitted_at").asc_nulls_last(), F.col("request_id").asc()]
        pending = pending.orderBy(*first).limit(max_items)
    chosen = pending.select("request_id", "url")
    return chosen.join(redirects, "url", "left").withColumn(
        "_id", F.coalesce(link_item_id("url"), link_item_id("target"))
    )


def queue_run(
    db: DataFrame,
    hist: DataFrame,
    queue: DataFrame,
    redirects: DataFrame,
    fetched: DataFrame,
    as_of: str,
    max_items: int | None = None,
    max_age_days: int = 4,
    links: LinkConfig = LinkConfig(),
) -> dict[str, DataFrame]:
    """One run of the request queue: ``queue``, ``songs`` and ``song_history`` after it.

    ``fetched`` (id, record) holds the landed item pages. Items of processed requests
    are inserted or updated and get one snapshot each.
    """
    asked = resolved_requests(queue, redirects, max_items).where(F.col("_id").isNotNull())
    asked = asked.select(F.col("_id").alias("id")).distinct()
    records = fetched.where(F.col("record").isNotNull()).join(asked, "id", "left_semi").select("id", "record")
    rows = materialize(flatten_records(records, db, as_of, "manual_queue", links))
    done = queue_process(queue, redirects, rows, as_of, max_items, max_age_days, links)
    done = materialize(done)
    accepted = done.where((F.col("status") == "processed") & (F.col("processed_at") == as_ts(as_of)))
    ok = rows.join(accepted.select(F.col("song_id").alias("id")).distinct(), "id", "left_semi")
    songs = normalize_text_columns(upsert_by_key(db, ok, ["id"]))
    grown = normalize_text_columns(history_append(hist, ok, as_of), ("title", "handle"))
    return {"queue": done, "songs": songs, "song_history": grown}


def queue_process(
    queue: DataFrame,
    redirects: DataFrame,
    fetched: DataFrame,
    as_of: str,
    max_items: int | None = None,
    max_age_days: int = 4,
    links: LinkConfig = LinkConfig(),
) -> DataFrame:
    """Queue after one run: pending requests (the first ``max_items``) become processed or failed.

    ``redirects`` (url, target) resolves short links, ``fetched`` (id, title,
    created_at) is what the item pages returned.
    """
    resolved = resolved_requests(queue, redirects, max_items)
    details = fetched.select(F.col("id").alias("_id"), F.col("title").alias("_title"), F.col("created_at").alias("_created"))
    details = details.withColumn("_found", F.lit(True))
    joined = resolved.join(details, "_id", "left")
    age_days = hours_between("_created", as_ts(as_of)) / 24.0
    error = (
        F.when(link_error("url", links).isNotNull(), link_error("url", links))
        .when(F.col("_id").isNull(), "link not resolved")
        .when(F.col("_found").isNull(), "failed to fetch item")
        .when(F.col("_created").isNull(), "created_at is missing or invalid")
        .when(age_days > max_age_days, F.concat(F.lit(f"older than {max_age_days} days: "), F.format_string("%.2f", age_days)))
    )
    results = joined.select(
        "request_id",
        F.coalesce(error, F.lit("")).alias("_error"),
        F.col("_id").alias("_song"),
        "_title",
    )
    out = queue.join(results.withColumn("_done", F.lit(True)), "request_id", "left")
    done = F.coalesce(F.col("_done"), F.lit(False))
    ok = done & (F.col("_error") == "")
    return out.withColumns(
        {
            "status": F.when(ok, "processed").when(done, "failed").otherwise(F.col("status")),
            "song_id": F.when(ok, F.col("_song")).otherwise(F.col("song_id")),
            "title": F.when(ok, F.col("_title")).otherwise(F.col("title")),
            "processed_at": F.when(done, as_ts(as_of)).otherwise(F.col("processed_at")),
            "error": F.when(done, F.col("_error")).otherwise(F.col("error")),
        }
    ).drop("_done", "_error", "_song", "_title")


def queue_dedupe(requests: DataFrame, queue: DataFrame) -> DataFrame:
    """Requests whose link is not already waiting in the queue."""
    waiting = queue.where(F.lower(F.trim(F.coalesce("status", F.lit("")))).isin(*PENDING_STATES))
    return salted_join(requests.where(~is_blank("url")), waiting.select("url").distinct(), ["url"], "left_anti")


def quality_targets(
    db: DataFrame, hist: DataFrame, as_of: str, ranking: RankingConfig = RankingConfig(), n: int | None = None
) -> DataFrame:
    """Contest-free active items, or the first ``n`` of their chart: whose comments are analysed."""
    if n is None:
        items = restored_catalog(db, prepare_history(hist))
        return filter_active(items, as_of, ranking.max_age_days, hide_contest=True)
    scored = active_scores(db, hist, as_of, ranking, dated_only=False, hide_contest=True)
    return ranked_top(scored, chart_order(), n)


def comment_quality_job(
    db: DataFrame,
    hist: DataFrame,
    stored: DataFrame,
    fetched: DataFrame,
    as_of: str,
    ranking: RankingConfig = RankingConfig(),
    cfg: QualityConfig = QualityConfig(),
) -> dict[str, DataFrame]:
    """Incremental comment quality.

    Adds unseen comments of targets that lack some, classifies what was not yet
    analysed, summarises the stored labels and writes them back.
    """
    targets = materialize(quality_targets(db, hist, as_of, ranking, cfg.top_n).select("id", "comment_count"))
    target_songs = targets.select(F.col("id").alias("song_id"), F.lit(True).alias("_target"))
    known = salted_join(stored, target_songs.select("song_id"), ["song_id"], "left_semi")
    lacking = fetch_needed(targets, known).select(F.col("id").alias("song_id"))
    wanted = salted_join(fetched, lacking, ["song_id"], "left_semi")
    new = unseen_comments(known, wanted, as_of)
    comments = salted_join(stored.unionByName(new, allowMissingColumns=True), target_songs, ["song_id"], "left", counted=stored)
    is_target = F.coalesce(F.col("_target"), F.lit(False))
    pending = is_blank("analyzed_at")
    fresh = mark_analyzed(comments.where(is_target & pending).drop("_target"), as_of)
    done = comments.where(is_target & ~pending)
    labels = ["song_id", "quality_label", "quality_weight"]
    labelled = done.select(*labels).unionByName(fresh.select(*labels))
    untouched = comments.where(~(is_target & pending)).drop("_target")
    summary = quality_summary(labelled, targets, cfg.empty_policy)
    return {
        "comments": untouched.unionByName(fresh, allowMissingColumns=True),
        "summary": summary,
        "songs": quality_writeback(db, summary, as_of),
    }
