"""Serving document: three lists from one candidate set, with item histories."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartlake.config import ChartConfig, CrewConfig, LinkConfig, RankingConfig
from chartlake.functions.coerce import display_time, iso_or_blank, parse_ts, to_number
from chartlake.functions.text import creator_display, lyrics_bundle, normalize_text_columns
from chartlake.operators.charts import (
    active_scores,
    chart_order,
    clear_movement,
    crew_filter,
    history_points,
    newest_order,
    ranked_top,
)
from chartlake.operators.scoring import outlier_flags
from chartlake.session import materialize
from chartlake.sources.tables import document_rows

TABS = {
    "new_songs": ("New", "newest items first"),
    "top200": ("Top", "highest trend score of recent items"),
    "crew": ("Crew", "newest items of listed members"),
}
NUMBERS = (
    "trend_score", "base_score", "growth_score", "freshness_score", "growth_score_raw",
    "play_delta_window", "upvote_delta_window", "comment_delta_window", "freshness", "age_hours",
    "effective_comment_count", "adjusted_comment_count",
)
LOUDNESS_NUMBERS = {
    "integrated_lufs": None,
    "true_peak_db": None,
    "loudness_gain_db": None,
    "loudness_target_lufs": -14.0,
    "loudness_true_peak_ceiling_db": -1.0,
}
TEXTS = ("user_id", "audio_url", "image_url", "loudness_status", "outlier_reasons", "rank_status")
# Columns that stand in for absent ones.
FALLBACKS = {
    "effective_comment_count": ("comment_count",),
    "adjusted_comment_count": ("comment_count",),
    "trend_score": ("current_score",),
}
SHOWN_TEXTS = (
    "title", "display_name", "handle", "song_url", "display_tags", "lyrics", "prompt", "gpt_description_prompt", *TEXTS,
)
COUNTS = ("play_count", "upvote_count", "comment_count")


def list_tabs(
    db: DataFrame,
    hist: DataFrame,
    as_of: str,
    crew: CrewConfig = CrewConfig(),
    ranking: RankingConfig = RankingConfig(),
    cfg: ChartConfig = ChartConfig(),
) -> dict[str, DataFrame]:
    """The three ranked lists of active items, each a distributed top-k.

    The scored active items feed the outlier statistics and all lists, so they
    are written once.
    """
    active = materialize(active_scores(db, hist, as_of, ranking))
    flagged = outlier_flags(active, cfg.outlier_sigma, cfg.outlier_log)
    return {
        "new_songs": clear_movement(ranked_top(flagged, newest_order(), cfg.new_limit)),
        "top200": ranked_top(flagged, chart_order(), cfg.top_n),
        "crew": clear_movement(ranked_top(crew_filter(flagged, crew), newest_order(), cfg.crew_limit)),
    }


def song_entries(tab: DataFrame, links: LinkConfig = LinkConfig(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Served fields of list rows, after the columns ``keep``."""

    tab = normalize_text_columns(tab, SHOWN_TEXTS)

    def has(name):
        return name in tab.columns

    def text(name):
        return F.col(name) if has(name) else F.lit("")

    def number(name, default=0.0):
        """The column, or the first of the fallback columns that is there, or the default."""
        there = next((c for c in (name, *FALLBACKS.get(name, ())) if has(c)), None)
        c = to_number(there, default) if there else F.lit(default).cast("double")
        return c.alias(name)

    creator, handle = creator_display(text("display_name"), text("handle"))
    url = text("song_url")
    lyrics = [F.col(c) for c in ("lyrics", "prompt", "gpt_description_prompt") if has(c)]
    fields = [
        F.col("rank").alias("rank"),
        number("rank_change", None),
        number("previous_rank", None),
        (F.col("current_rank").cast("double") if has("current_rank") else F.lit(None).cast("double")).alias("current_rank_saved"),
        F.col("id"),
        F.coalesce(F.nullif(text("title"), F.lit("")), F.lit("Untitled")).alias("title"),
        creator.alias("creator"),
        handle.alias("handle"),
        display_time("created_at").alias("created_at"),
        iso_or_blank("created_at").alias("created_at_raw"),
        text("display_tags").alias("style_tags"),
        *[F.col(c).cast("long").alias(c) for c in COUNTS],
        number("comment_quality_ratio", 1.0),
        (F.coalesce("is_outlier", F.lit(False)) if has("is_outlier") else F.lit(False)).alias("is_outlier"),
        F.when(url != "", url).otherwise(F.concat(F.lit(links.item_url_prefix), "id")).alias("song_url"),
        *[text(c).alias(c) for c in TEXTS],
        *[number(c, d) for c, d in LOUDNESS_NUMBERS.items()],
        (lyrics_bundle(*lyrics) if lyrics else F.lit("")).alias("lyrics"),
        *[number(c) for c in NUMBERS],
    ]
    return tab.select(*keep, *fields)


def tab_documents(listed: DataFrame, points: DataFrame) -> DataFrame:
    """One row (part, document) per list of ``listed`` (``part`` and the rows of the list).

    ``points`` are the histories of the listed items. Lists and histories are short; a
    list without rows has an empty document.
    """
    entries = song_entries(listed, keep=("part",))
    song = F.struct("rank", F.struct(*[c for c in entries.columns if c != "part"]).alias("song"))
    songs = entries.groupBy("part").agg(F.transform(F.sort_array(F.collect_list(song)), lambda x: x["song"]).alias("songs"))
    shown = points.join(listed.select("part", "id").distinct(), "id")
    histories = shown.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("id", "points"))).alias("histories"))
    facts = F.array(*[
        F.struct(F.lit(n).alias("part"), F.lit(t).alias("title"), F.lit(d).alias("description")) for n, (t, d) in TABS.items()
    ])
    tabs = listed.sparkSession.range(1).select(F.inline(facts))
    none = {n: F.from_json(F.lit(e), f.dataType) for n, e, f in (
        ("songs", "[]", songs.schema["songs"]), ("histories", "{}", histories.schema["histories"])
    )}
    out = tabs.join(songs, "part", "left").join(histories, "part", "left")
    out = out.withColumns({n: F.coalesce(n, empty) for n, empty in none.items()})
    document = F.struct("title", "description", F.size("songs").alias("count"), "songs", "histories")
    return out.select("part", document.alias("document"))


def tab_document(name: str, tab: DataFrame, hist: DataFrame, cfg: ChartConfig = ChartConfig()) -> DataFrame:
    """The row of one list alone."""
    points = history_points(hist, tab.select("id"), cfg.history_points)
    return tab_documents(tab.withColumn("part", F.lit(name)), points).where(F.col("part") == name)


def app_payload(
    db: DataFrame,
    hist: DataFrame,
    as_of: str,
    crew: CrewConfig = CrewConfig(),
    ranking: RankingConfig = RankingConfig(),
    cfg: ChartConfig = ChartConfig(),
) -> DataFrame:
    """Serving document, one row per list; lists are stored as one table, and the history is read once for all."""
    tabs = list_tabs(db, hist, as_of, crew, ranking, cfg)
    rows = [t.withColumn("part", F.lit(n)) for n, t in tabs.items()]
    listed = materialize(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows))
    points = materialize(history_points(hist, listed.select("id"), cfg.history_points))
    return tab_documents(listed, points)


def serving_rows(payload: DataFrame, meta: DataFrame) -> DataFrame:
    """Rows (key, part, payload_json) to store: the lists and the document facts."""
    facts = meta.select(F.lit("meta").alias("part"), F.struct(*meta.columns).alias("document"))
    return document_rows(payload).unionByName(document_rows(facts))


def document_songs(parts: DataFrame) -> DataFrame:
    """Table of the songs of parsed document parts, with the creation time typed."""
    songs = parts.select("part", F.explode("document.songs").alias("_s")).select("part", "_s.*")
    raw = F.coalesce(F.nullif(F.col("created_at_raw"), F.lit("")), F.col("created_at"))
    return songs.withColumn("created_at", parse_ts(raw))
