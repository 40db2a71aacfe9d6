"""Ordinals and running totals that never put one large group into one task."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartlake.session import materialize

# monotonically_increasing_id keeps the row index of a partition in its low bits.
ROW_INDEX_BITS = 33
# Rows that one task may put in order.
HOT_ROWS = 2_000_000


def global_ordinal(df: DataFrame, order: Sequence[Column], name: str = "rank", partitions: int | None = None):
    """1-based ordinal of the whole frame in ``order`` (which must be total).

    Range partitions are numbered locally and shifted by the sizes of the
    partitions before them. Only one row per partition is broadcast. The ranged
    frame is written once, because both reads must see the same partitioning.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    numbered = materialize(ranged.withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", ROW_INDEX_BITS)
    index = F.col("_row").bitwiseAND(F.lit((1 << ROW_INDEX_BITS) - 1))
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    joined = numbered.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return joined.withColumn(name, F.col("_offset") + index + 1).drop("_row", "_part", "_offset")


def ordinals_of(
    df: DataFrame, wanted: Column, order: Sequence[Column], coarse: Column, name: str = "rank", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The ``wanted`` rows of a stored frame with their 1-based ordinal among all rows in ``order``.

    ``coarse`` must fall as ``order`` goes on (nulls last) and cuts the rows into ranges.
    A histogram of the ranges, combined map-side, tells how many rows lie before each;
    only ranges with a wanted row are ordered, each by itself. Ranges with more than
    ``hot_rows`` rows are ordered by a distributed sort. The histogram has one row per
    range and is summed up in one task.
    """
    ranged = df.withColumn("_range", coarse)
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"), F.count_if(wanted).alias("_wanted"))
    before = Window.orderBy(F.col("_range").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("_base", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    held = materialize(bases.where("_wanted > 0").select("_range", "_rows", "_base"))
    rows = ranged.join(F.broadcast(held), ranged["_range"].eqNullSafe(held["_range"])).drop(held["_range"])
    small = rows.where(F.col("_rows") <= hot_rows)
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    out = small.withColumn(name, (F.col("_base") + place).cast("long"))
    large = held.where(F.col("_rows") > hot_rows)
    if not large.isEmpty():
        sorted_ = global_ordinal(rows.where(F.col("_rows") > hot_rows), order, "_place")
        ahead = Window.orderBy(F.col("_range").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
        skipped = large.select("_range", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_skipped"))
        placed = sorted_.join(F.broadcast(skipped), sorted_["_range"].eqNullSafe(skipped["_range"])).drop(skipped["_range"])
        number = (F.col("_base") + F.col("_place") - F.col("_skipped")).cast("long")
        out = out.unionByName(placed.withColumn(name, number).drop("_place", "_skipped"))
    return out.where(wanted).drop("_range", "_rows", "_base")


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    values: Mapping[str, Column],
) -> DataFrame:
    """Running sums per key over ``order``, in two levels.

    ``bucket`` must grow with ``order`` and bounds the rows of one window group:
    rows are summed within (key, bucket), and the per-bucket totals, combined
    map-side, are summed over the buckets of a key. A hot key is thus spread over
    its buckets.
    """
    staged = df.withColumn("_bucket", bucket).withColumns({f"_v_{k}": v.cast("long") for k, v in values.items()})
    group = [*keys, "_bucket"]
    upto = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = staged.withColumns({f"_l_{k}": F.sum(f"_v_{k}").over(upto) for k in values})
    totals = staged.groupBy(*group).agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in values])
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*group, *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_c_{k}") for k in values])
    out = local.join(carried, group)
    out = out.withColumns({k: F.col(f"_c_{k}") + F.col(f"_l_{k}") for k in values})
    helpers = [f"_{p}_{k}" for p in ("v", "l", "c") for k in values]
    return out.drop("_bucket", *helpers)
