"""The catalogue refresh on stored tables: a run writes what it changes."""
from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartlake.config import LinkConfig, RankingConfig, TierConfig
from chartlake.functions.text import normalize_text_columns
from chartlake.operators.catalog import history_append, update_tiers, upsert_by_key
from chartlake.operators.scoring import prepare_history
from chartlake.plans.jobs import refresh_changes
from chartlake.plans.upkeep import add_growth, compact_days, upsert_table
from chartlake.session import materialize, measured_broadcasts, scratch
from chartlake.sources.parts import KeyedTable, PartTable

RUN = "refresh"


@dataclass(frozen=True)
class ChartTables:
    """Catalogue by id, snapshots by day and, if it is kept, the growth state by id."""

    songs: KeyedTable
    history: PartTable
    growth: KeyedTable | None = None


def aligned(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` in its types; absent ones are null, others dropped."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ])


def changed_rows(now: DataFrame, before: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``now`` that ``before`` (of the same columns) lacks or has with other values."""
    mark = F.xxhash64(*now.columns)
    known = before.select(key, mark.alias("_before"))
    out = now.withColumn("_now", mark).join(known, key, "left")
    return out.where(F.col("_before").isNull() | (F.col("_before") != F.col("_now"))).select(now.columns)


def refresh_tables(
    tables: ChartTables,
    feed: DataFrame,
    fetched: DataFrame,
    playlist_items: DataFrame | None,
    as_of: str,
    tiers: TierConfig = TierConfig(),
    links: LinkConfig = LinkConfig(),
    ranking: RankingConfig = RankingConfig(),
) -> dict[str, list[str]]:
    """One run of ``catalog_refresh`` in place; returns the parts of each table that were rewritten.

    The catalogue is read, and its changed rows alone are written. The snapshots of
    refreshed items are appended to their day, and days that passed the line are
    compacted. The catalogue is written last: until then a run that failed can be
    repeated with the same inputs and time, and tables it has written are left alone.
    Joins are broadcast by measured sizes, as most columns of a catalogue are empty.
    """
    songs, history = tables.songs, tables.history
    run = int(datetime.fromisoformat(as_of).replace(tzinfo=timezone.utc).timestamp())
    with scratch(songs.spark), measured_broadcasts(songs.spark):
        stored = songs.read()
        known, ok, updates = refresh_changes(stored, history.read(), feed, fetched, playlist_items, as_of, tiers, links)
        upserted = normalize_text_columns(upsert_by_key(known, updates, ["id"]))
        now = aligned(update_tiers(upserted, playlist_items, as_of, tiers), songs.schema)
        changed = materialize(changed_rows(now, stored))
        grown = history_append(songs.spark.createDataFrame([], history.schema), ok, as_of)
        snapshots = materialize(aligned(normalize_text_columns(grown, ("title", "handle")), history.schema))
        out = {"song_history": history.append(snapshots, RUN, run)}
        if tables.growth is not None:
            out["growth"] = add_growth(tables.growth, ok, prepare_history(snapshots), ranking, RUN, run)
        out["songs"] = upsert_table(songs, changed)
    out["song_history"] = sorted({*out["song_history"], *compact_days(history, as_of)})
    return out
