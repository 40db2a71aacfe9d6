"""Mix sources to target weights along a curriculum.

Every source has a weight schedule over training time 0..1, a piecewise linear
curve given by knots. Its integral is the source's weight. Targets share a total
by weight, with a ceiling of ``max_repeats`` times the source's size; the excess is
shared anew by weight. A document stands at a place in its source's token demand,
the cumulative size in a fixed random order; inverting the demand curve gives its
training position, and documents are range-sorted by position.

DataFrame functions only. The running size is a two-level sum: within (source,
slice of the order) and over the slice totals, so that no source meets in one task.

Defined results: a null text has size 0; null is a source of its own, last in
order; a source of size 0 gets target 0, and its documents are taken 0 times; the
order of documents is the MD5 of doc_id as text (null as empty), then size, so
reruns agree and repeated rows are interchangeable; an empty table gives no rows; other
columns pass through, and added columns replace columns of the same name.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartlake.session import materialize

Knots = Sequence[tuple[float, float]]

#: Schedules by source rank, repeating; their integrals are the weights 5, 2 and 1.
CURRICULUM: tuple[Knots, ...] = (
    ((0.0, 6.0), (1.0, 4.0)),
    ((0.0, 2.0), (1.0, 2.0)),
    ((0.0, 0.5), (1.0, 1.5)),
)
#: Hexadecimal digits of the order key that name a slice: 4096 slices a source.
SLICE_DIGITS = 3
#: Columns that planning adds; they replace columns of the same name.
ADDED = (
    "source_size", "target", "schedule", "place", "copies", "taken", "copy", "position",
    "_key", "_group", "_slice", "_sum", "_start", "_of",
)


def areas(knots: Knots) -> list[float]:
    """Integral of a schedule from 0 to each knot."""
    total = [0.0]
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        total.append(total[-1] + (t1 - t0) * (w0 + w1) / 2)
    return total


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and control white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def invert_demand(share: Column, schedule: Column, curriculum: Sequence[Knots]) -> Column:
    """Time at which a schedule has used up ``share`` (0..1) of its integral."""
    result = F.lit(None).cast("double")
    for number, knots in reversed(list(enumerate(curriculum))):
        area = areas(knots)
        used = share * area[-1]
        time = F.lit(float(knots[-1][0]))
        for (t0, w0), (t1, w1), a0, a1 in reversed(list(zip(knots, knots[1:], area, area[1:]))):
            slope = (w1 - w0) / (t1 - t0)
            rest = used - a0
            if slope == 0:
                inside = t0 + rest / w0 if w0 else F.lit(float(t1))
            else:
                inside = t0 + (F.sqrt(F.greatest(w0 * w0 + 2 * slope * rest, F.lit(0.0))) - w0) / slope
            time = F.when(used <= a1, inside).otherwise(time)
        result = F.when(schedule == number, time).otherwise(result)
    return result


def source_targets(
    sizes: DataFrame,
    curriculum: Sequence[Knots] = CURRICULUM,
    share: float = 1.5,
    max_repeats: float = 2.0,
    source: str = "source",
    size: str = "size",
) -> DataFrame:
    """One row per source: ``source_size``, ``schedule`` (its index) and ``target``.

    The level of the sharing is found from sources ordered by how soon they reach
    their ceiling; the windows run over one row per source.
    """
    weights = F.array(*[F.lit(areas(k)[-1]) for k in curriculum])
    totals = sizes.groupBy(source).agg(F.sum(size).alias("source_size"))
    ranked = totals.withColumn(
        "schedule", (F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1) % len(curriculum)
    ).withColumn("_weight", F.get(weights, F.col("schedule")))
    ceiling = F.col("source_size") * max_repeats
    soonest = Window.orderBy(ceiling / F.col("_weight"), F.col(source).asc_nulls_last())
    before = soonest.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.coalesce(F.sum(ceiling).over(before), F.lit(0.0))
    open_weight = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    level = (F.sum("source_size").over(everything) * share - full) / open_weight
    levels = ranked.withColumn("_level", level).withColumn("_reach", ceiling / F.col("_weight"))
    # The first level that its own source doesn't exceed holds for all sources.
    first = F.min_by("_level", F.when(F.col("_level") <= F.col("_reach"), F.col("_reach"))).over(everything)
    return levels.select(
        source, "source_size", "schedule", F.least(ceiling, first * F.col("_weight")).alias("target")
    )


def plan_mix(
    docs: DataFrame,
    curriculum: Sequence[Knots] = CURRICULUM,
    share: float = 1.5,
    max_repeats: float = 2.0,
    doc_id: str = "doc_id",
    source: str = "source",
    size: str = "size",
) -> DataFrame:
    """``docs`` (with a ``size`` column) plus ``source_size``, ``target``, ``schedule``,
    ``place`` (sizes before it in its source), ``copies`` and ``taken`` (size times copies).

    A copy is taken if the middle of its place lies within the source's target, so a
    source's taken size differs from its target by half a document at most.
    """
    docs = docs.drop(*ADDED)
    key = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    keyed = docs.withColumn("_key", key).withColumn("_slice", F.substring("_key", 1, SLICE_DIGITS))
    # A source's key is never null, so the join and the window share one shuffle.
    keyed = keyed.withColumn("_group", F.when(F.col(source).isNull(), "").otherwise(F.concat(F.lit("="), source)))
    slices = materialize(keyed.groupBy(source, "_group", "_slice").agg(F.sum(size).alias("_sum")))
    targets = source_targets(
        slices.withColumnRenamed("_sum", size), curriculum, share, max_repeats, source, size
    )
    earlier = Window.partitionBy("_group").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.withColumn("_start", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    targets = targets.withColumnRenamed(source, "_of")
    starts = starts.join(targets, F.col(source).eqNullSafe(F.col("_of"))).drop("_of", source)
    placed = keyed.join(starts, ["_group", "_slice"])
    within = Window.partitionBy("_group", "_slice").orderBy("_key", size).rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("_start") + F.coalesce(F.sum(size).over(within), F.lit(0))
    placed = placed.withColumn("place", place)
    middle = F.col("place") + F.col(size) / 2
    whole = F.floor((F.col("target") - middle) / F.col("source_size")) + 1
    copies = F.when(F.col(size) > 0, F.greatest(whole, F.lit(0))).otherwise(0).cast("int")
    placed = placed.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col(size))
    return placed.drop("_key", "_group", "_slice", "_start")


def positions(copy: Column, curriculum: Sequence[Knots] = CURRICULUM, size: str = "size") -> Column:
    """Training position 0..1 of a copy (numbered from 0) of a planned document."""
    used = F.col("place") + copy * F.col("source_size") + F.col(size) / 2
    return invert_demand(used / F.col("target"), F.col("schedule"), curriculum)


def mix(docs: DataFrame, curriculum: Sequence[Knots] = CURRICULUM, **options) -> DataFrame:
    """The taken copies of ``docs`` with ``copy`` and ``position``, range-sorted by position."""
    size = options.get("size", "size")
    planned = plan_mix(docs, curriculum, **options).where(F.col("copies") > 0)
    copies = planned.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return copies.withColumn("position", positions(F.col("copy"), curriculum, size)).orderBy("position", "copy")
