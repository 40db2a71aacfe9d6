"""Filters, top-N lists, rank movement and list views."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartlake.config import CrewConfig, RankingConfig
from chartlake.functions.coerce import any_of, as_ts, col, plus_hours, strip
from chartlake.functions.text import normalize_handle
from chartlake.operators.ordinal import global_ordinal
from chartlake.operators.scoring import COUNTERS, prepare_history, restored_catalog, score_items
from chartlake.operators.skew import salted_join
from chartlake.session import materialize

SCORE_DIGITS = 6
RANK_COLUMNS = (
    "previous_rank", "current_rank", "rank_change", "rank_status",
    "current_score", "base_score", "growth_score", "freshness_score",
    "best_rank", "best_trend_score", "best_score_at",
    "peak_play_count", "peak_upvote_count", "peak_comment_count", "peak_adjusted_comment_count",
)
RANK_HISTORY_COLUMNS = (
    "captured_at", "id", "rank",
    "trend_score", "base_score", "growth_score", "freshness_score",
    "play_count", "upvote_count", "comment_count", "adjusted_comment_count",
)


def cutoff(as_of: str, days: int) -> Column:
    return plus_hours(as_ts(as_of), -24.0 * days)


def not_contest(df: DataFrame) -> Column:
    """Three null-tolerant contest tests; an absent column passes."""
    tests = [F.lit(True)]
    if "is_contest_clip" in df.columns:
        tests.append(F.coalesce(F.lower(F.col("is_contest_clip").cast("string")), F.lit("")) != "true")
    if "download_disabled_reason" in df.columns:
        tests.append(F.coalesce(F.col("download_disabled_reason"), F.lit("")) != "remix_contest")
    if "contest_ids" in df.columns:
        tests.append(F.lower(strip(F.coalesce(F.col("contest_ids"), F.lit("")))).isin("", "nan", "none"))
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def filter_active(df: DataFrame, as_of: str, max_age_days: int = 4, hide_contest: bool = False) -> DataFrame:
    """Items without or with a recent creation time; optionally without contest items."""
    view = df.where(not_contest(df)) if hide_contest else df
    return view.where(F.col("created_at").isNull() | (F.col("created_at") >= cutoff(as_of, max_age_days)))


def chart_candidates(df: DataFrame, as_of: str, max_age_days: int = 4) -> DataFrame:
    """Items with a known, recent creation time."""
    return df.where(F.col("created_at") >= cutoff(as_of, max_age_days))


def crew_filter(df: DataFrame, crew: CrewConfig) -> DataFrame:
    """Items of listed members by handle, user id or display name (case-insensitive)."""
    tests = []
    handles = [h.lstrip().removeprefix("@").lower() for h in crew.handles if h.strip()]
    if handles:
        tests.append(F.lower(normalize_handle("handle")).isin(handles))
    for name, listed in (("user_id", crew.user_ids), ("display_name", crew.display_names)):
        values = [v.strip().lower() for v in listed if v.strip()]
        if values:
            tests.append(F.lower(strip(F.coalesce(F.col(name), F.lit("")))).isin(values))
    return df.where(any_of(*tests)) if tests else df.where(F.lit(False))


def chart_order(score: str = "trend_score") -> list[Column]:
    """The one chart order: rounded score, then newest, then id (nulls last)."""
    return [
        F.round(F.col(score), SCORE_DIGITS).desc_nulls_last(),
        F.col("created_at").desc_nulls_last(),
        F.col("id").asc(),
    ]


def newest_order() -> list[Column]:
    return [F.col("created_at").desc_nulls_last(), F.col("id").asc()]


def ranked_top(df: DataFrame, order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """First ``n`` rows with their ordinal.

    The limit runs as a distributed top-k; only its ``n`` rows are numbered.
    """
    limited = df.orderBy(*order).limit(n)
    return limited.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


def ranked(df: DataFrame, order: Sequence[Column], n: int | None, name: str = "rank") -> DataFrame:
    """All rows with their ordinal, or the first ``n``."""
    return global_ordinal(df, order, name) if n is None else ranked_top(df, order, n, name)


def clear_movement(df: DataFrame) -> DataFrame:
    """Lists that are not rankings show no movement."""
    blanks = {
        "rank_change": F.lit(None).cast("double"),
        "previous_rank": F.lit(None).cast("double"),
        "current_rank": F.lit(None).cast("double"),
        "rank_status": F.lit(""),
    }
    return df.withColumns({k: v for k, v in blanks.items() if k in df.columns})


def active_scores(
    db: DataFrame,
    hist: DataFrame,
    as_of: str,
    cfg: RankingConfig = RankingConfig(),
    dated_only: bool = True,
    hide_contest: bool = False,
) -> DataFrame:
    """Scores of recent items only.

    Same rows and values as scoring everything and filtering afterwards, but the
    growth join sees only recent items, and of the history only what can lie
    after their creation: a time filter that reaches the scan.
    """
    history = prepare_history(hist)
    items = restored_catalog(db, history)
    if dated_only:
        items = chart_candidates(items, as_of, cfg.max_age_days)
    else:
        items = filter_active(items, as_of, cfg.max_age_days, hide_contest)
    recent = history.where(F.col("checked_at") >= cutoff(as_of, cfg.max_age_days))
    return score_items(items, recent, as_of, cfg)


def trend_chart(db: DataFrame, hist: DataFrame, as_of: str, cfg: RankingConfig = RankingConfig(), n: int = 200):
    """The flagship chart: the top ``n`` of the recent items by trend score."""
    return ranked_top(active_scores(db, hist, as_of, cfg), chart_order(), n)


def movement(chart: DataFrame, has_previous: Column, previous: str = "previous_rank", rank: str = "rank") -> DataFrame:
    """rank_change and rank_status of ranked rows that carry their previous rank."""
    change = F.col(previous) - F.col(rank)
    status = (
        F.when(~has_previous, "")
        .when(F.col(previous).isNull(), "new")
        .when(change == 0, "same")
        .when(change > 0, "up")
        .otherwise("down")
    )
    return chart.withColumns({"rank_change": change, "rank_status": status})


def rank_chart(db: DataFrame, hist: DataFrame, as_of: str, cfg=RankingConfig(), n: int = 200) -> DataFrame:
    """Top-N of active items with movement against the stored ``current_rank``."""
    stored = F.col("current_rank").cast("double") if "current_rank" in db.columns else F.lit(None).cast("double")
    scored = active_scores(db, hist, as_of, cfg, dated_only=False).withColumn("previous_rank", stored)
    chart = ranked_top(scored, chart_order(), n)
    any_rank = db.agg(F.max(stored).isNotNull().alias("_has_previous"))
    return movement(chart.crossJoin(F.broadcast(any_rank)), F.col("_has_previous")).drop("_has_previous")


def rank_movement(
    db: DataFrame, hist: DataFrame, as_of: str, cfg=RankingConfig(), n: int = 200, carry_forward: bool = True
) -> DataFrame:
    """Catalogue with fresh rank columns.

    ``carry_forward`` keeps earlier best and peak values; without it they start
    over at every run. At most ``n`` ranked rows are broadcast.
    """
    chart = rank_chart(db, hist, as_of, cfg, n).select(
        "id",
        F.col("rank").alias("current_rank"),
        "previous_rank",
        "rank_change",
        "rank_status",
        F.col("trend_score").alias("current_score"),
        "base_score",
        "growth_score",
        "freshness_score",
        F.col("play_count").alias("_play"),
        F.col("upvote_count").alias("_upvote"),
        F.col("comment_count").alias("_comment"),
        F.col("effective_comment_count").alias("_adjusted"),
    )

    def old(name: str, kind: str = "double") -> Column:
        kept = carry_forward and name in db.columns
        return F.col(f"_old_{name}").cast(kind) if kept else F.lit(None).cast(kind)

    keep = {f"_old_{c}": F.col(c) for c in RANK_COLUMNS if c in db.columns}
    base = db.withColumns(keep).drop(*[c for c in RANK_COLUMNS if c in db.columns])
    out = base.join(F.broadcast(chart), "id", "left")
    score = F.col("current_score")
    improved = score.isNotNull() & (old("best_trend_score").isNull() | (score > old("best_trend_score")))
    out = out.withColumns(
        {
            "best_rank": F.least(old("best_rank"), F.col("current_rank").cast("double")),
            "best_trend_score": F.greatest(old("best_trend_score"), score),
            "best_score_at": F.when(improved, as_ts(as_of)).otherwise(old("best_score_at", "timestamp_ntz")),
            "peak_play_count": F.greatest(old("peak_play_count"), F.col("_play")),
            "peak_upvote_count": F.greatest(old("peak_upvote_count"), F.col("_upvote")),
            "peak_comment_count": F.greatest(old("peak_comment_count"), F.col("_comment")),
            "peak_adjusted_comment_count": F.greatest(old("peak_adjusted_comment_count"), F.col("_adjusted")),
        }
    )
    return out.drop("_play", "_upvote", "_comment", "_adjusted", *keep)


def rank_history_append(
    rank_history: DataFrame, chart: DataFrame, captured_at: str, retention_days: int = 4
) -> DataFrame:
    """Chart history with one more capture, without captures past the retention.

    A capture is at most N rows and replaces an earlier capture of the same key.
    """
    snapshot = materialize(chart).select(
        as_ts(captured_at).alias("captured_at"),
        F.col("id").cast("string").alias("id"),
        F.col("rank").cast("long").alias("rank"),
        *[F.col(c).cast("double") for c in ("trend_score", "base_score", "growth_score", "freshness_score")],
        *[F.col(c).cast("long") for c in ("play_count", "upvote_count", "comment_count")],
        F.col("effective_comment_count").cast("double").alias("adjusted_comment_count"),
    )
    limit = plus_hours(as_ts(captured_at), -(24.0 * max(retention_days, 1) + 6.0))
    kept = rank_history.where(F.col("captured_at").isNull() | (F.col("captured_at") >= limit))
    replaced = kept.join(snapshot.select("captured_at", "id"), ["captured_at", "id"], "left_anti")
    return replaced.select(*RANK_HISTORY_COLUMNS).unionByName(snapshot.select(*RANK_HISTORY_COLUMNS))


def latest_first(hist: DataFrame) -> list[Column]:
    """Total order of snapshots: newest, then larger counters, then a hash of the row."""
    grown = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in COUNTERS[:3] if c in hist.columns]
    size = reduce(Column.__add__, grown, F.lit(0.0))
    return [F.col("checked_at").desc_nulls_last(), size.desc(), F.xxhash64(*hist.columns).desc()]


def history_points(hist: DataFrame, ids: DataFrame, k: int = 80) -> DataFrame:
    """Last ``k`` snapshots of listed ids as one ordered array per id.

    Spark limits each group before the shuffle, so an id with many snapshots
    sends at most ``k`` rows per task.
    """
    narrow = hist.select("id", "checked_at", *COUNTERS[:3])
    listed = salted_join(narrow, ids.select("id").distinct(), ["id"], "left_semi", counted=hist.select("id"))
    newest = Window.partitionBy("id").orderBy(*latest_first(listed))
    picked = listed.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= k)
    point = F.struct(
        F.date_format("checked_at", "MM-dd HH:mm").alias("checked_at"),
        *[F.col(c).cast("long").alias(c) for c in COUNTERS[:3]],
    )
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("_n")).alias("o"), point.alias("p"))))
    return picked.groupBy("id").agg(F.transform(ordered, lambda x: x["p"]).alias("points"))


def top_by_metric(df: DataFrame, chart_ids: DataFrame, metrics: Sequence[str], k: int = 20) -> DataFrame:
    """Top ``k`` per counter with a flag whether the item is in the chart.

    One pass: every row is paired with its counters, and each task keeps ``k``
    rows per counter before the shuffle.
    """
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("long").alias("metric_value")) for m in metrics])
    w = Window.partitionBy("metric").orderBy(F.col("metric_value").desc_nulls_last(), F.col("id").asc())
    top = df.select("id", F.inline(pairs)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    flags = chart_ids.select("id", F.lit(True).alias("_in"))
    out = top.withColumn("rank", F.col("rank").cast("long")).join(flags, "id", "left")
    return out.withColumn("in_chart", F.coalesce("_in", F.lit(False))).drop("_in")


SEARCH_COLUMNS = ("title", "style_tags", "creator", "handle", "id")


def search_text(columns: Sequence[str] = SEARCH_COLUMNS) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns]))


def search_songs(df: DataFrame, query: str, columns: Sequence[str] = SEARCH_COLUMNS) -> DataFrame:
    return df.where(F.contains(search_text(columns), F.lit(query.strip().lower())))


def natural_key(c: Column | str, collation: str = "UNICODE_CI_AI") -> Column:
    """Sort key in which runs of digits compare as numbers and letters by a collation.

    Digits lose leading zeros and are headed by their count, so that a longer number
    comes later; runs of up to 999 digits keep their order.
    """
    runs = F.regexp_extract_all(col(c), F.lit("[0-9]+|[^0-9]+"), F.lit(0))

    def fixed(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+(?=.)", "")
        width = F.lpad(F.length(digits).cast("string"), 3, "0")
        return F.when(F.regexp_like(run, F.lit("^[0-9]")), F.concat(width, digits)).otherwise(run)

    return F.collate(F.array_join(F.transform(runs, fixed), ""), collation)


def view_sort(df: DataFrame, key: str, descending: bool = True, limit: int = 200, collation: str | None = None) -> DataFrame:
    """List view: sorted by a chosen column, ties by rank in the same direction.

    Texts compare by their code points without case, or in natural order if a
    collation is given (such as ``ko_CI_AI``; base letters, neither case nor accents).
    """
    text = dict(df.dtypes)[key] == "string"
    value = (F.lower(key) if collation is None else natural_key(key, collation)) if text else F.col(key)
    order = [value, F.col("rank")]
    order = [c.desc_nulls_last() for c in order] if descending else [c.asc_nulls_last() for c in order]
    return ranked_top(df, order, limit, "view_position")


def curate(df: DataFrame, theme: str, k: int, score: str = "trend_score") -> DataFrame:
    """Best theme matches: number of theme terms in the text plus a hundredth of the score."""
    terms = [t for t in theme.replace(",", " ").lower().split() if t]
    text = F.lower(
        F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "style_tags", "description")])
    )
    hits = F.lit(0)
    for t in terms:
        hits = hits + F.contains(text, F.lit(t)).cast("int")
    match = hits.cast("double") + F.coalesce(F.col(score), F.lit(0.0)) / 100.0
    scored = df.withColumn("match_score", F.round(match, SCORE_DIGITS))
    order = [F.col("match_score").desc(), *chart_order(score)]
    return ranked_top(scored, order, k, "position")


def current_chart(db: DataFrame) -> DataFrame:
    """Ranked rows of the catalogue (ordering is the reader's ``orderBy('current_rank')``)."""
    return db.where(F.col("current_rank").isNotNull())


