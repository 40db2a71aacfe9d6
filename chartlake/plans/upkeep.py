"""Upkeep of stored tables whose cost follows the change, not the table.

The catalogue and the growth state are tables in hash buckets of the id, the history is
a table in days. A run writes the buckets that hold a changed item, and the days that
a snapshot was added to or that passed the line behind which days are compacted.
"""
from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartlake.config import RankingConfig
from chartlake.operators.catalog import history_compact, upsert_by_key
from chartlake.operators.scoring import GROWTH_STATE, growth_state, merge_growth
from chartlake.sources.parts import KeyedTable, PartTable

UNDATED = "none"
COMPACT = "compact"


# Catalogue --------------------------------------------------------------------
def upsert_table(table: KeyedTable, updates: DataFrame, order: Sequence[Column] | None = None) -> list[str]:
    """``upsert_by_key`` into a stored table; returns the buckets that were rewritten."""
    return table.merge(updates, lambda old, new: upsert_by_key(old, new, table.keys, order))


# History ----------------------------------------------------------------------
def history_table(spark: SparkSession, path: str, schema: T.StructType) -> PartTable:
    """Snapshots in parts by day of ``checked_at``; undated ones are a part of their own."""
    return PartTable(spark, path, schema, F.coalesce(F.date_format("checked_at", "yyyy-MM-dd"), F.lit(UNDATED)))


def compact_days(table: PartTable, as_of: str, high_res_days: int = 7) -> list[str]:
    """``history_compact`` in place; returns the days that were rewritten.

    A day that lies wholly behind the line is rewritten once and then marked, until
    snapshots are added to it. The day that the line crosses is rewritten without a mark.
    """
    line = datetime.fromisoformat(as_of) - timedelta(days=high_res_days)
    _, held = table.listing()
    whole = line.date().isoformat()
    last = whole if line.time() != datetime.min.time() else None
    due = [p for p in held["parts"] if p != UNDATED and (p < whole or p == last) and held["marks"].get(p) != COMPACT]
    if due:
        rows = history_compact(table.read(due), as_of, high_res_days)
        table.replace(rows, due, marks={p: COMPACT for p in due if p < whole})
    return sorted(due)


# Listeners --------------------------------------------------------------------
SKETCHES = T.StructType(
    [T.StructField("song_id", T.StringType()), T.StructField("day", T.DateType()), T.StructField("sketch", T.BinaryType())]
)


def listener_table(spark: SparkSession, path: str) -> PartTable:
    """Listener sketches in parts by day (see ``listener_sketches``).

    New plays are appended; the listeners of a span of days are read from its parts
    alone, with ``listeners_of(table.read(days))``.
    """
    return PartTable(spark, path, SKETCHES, F.coalesce(F.date_format("day", "yyyy-MM-dd"), F.lit(UNDATED)))


def merge_sketches(rows: DataFrame) -> DataFrame:
    """One sketch per song and day; for ``PartTable.fold``."""
    return rows.groupBy("song_id", "day").agg(F.hll_union_agg("sketch", F.lit(False)).alias("sketch"))


# Growth -----------------------------------------------------------------------
def growth_table(spark: SparkSession, path: str, buckets: int = 64) -> KeyedTable:
    """Stored first and last snapshots of each item (see ``growth_state``)."""
    return KeyedTable(spark, path, GROWTH_STATE, ["id"], buckets)


def add_growth(
    table: KeyedTable, db: DataFrame, snapshots: DataFrame, cfg: RankingConfig = RankingConfig(), stream: str | None = None,
    batch_id: int | None = None,
) -> list[str]:
    """Merge new snapshots into the growth state of their items. Every snapshot is given once."""
    return table.merge(growth_state(db, snapshots, cfg), merge_growth, stream, batch_id)


def rebuild_growth(table: KeyedTable, db: DataFrame, hist: DataFrame, cfg: RankingConfig = RankingConfig()) -> list[str]:
    """Growth state of the items ``db`` anew from all their snapshots, after their creation time changed."""
    ids = db.select("id").distinct()
    fresh = growth_state(db, hist.join(ids, "id", "left_semi"), cfg)
    gone = ids.join(fresh, "id", "left").select(*table.schema.names)  # also those without a snapshot now

    def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.join(new.select("id"), "id", "left_anti").unionByName(new.where("_n is not null"))

    return table.merge(gone, replaced)
