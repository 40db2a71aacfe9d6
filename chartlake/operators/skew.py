"""Joins that spread hot keys, independent of the shape of their inputs.

Adaptive skew handling only splits a join whose inputs are plain shuffles. Here
the keys that hold very many rows are counted first (combined map-side) and only
these are salted: their rows go to several tasks, and the other side of the join
is repeated for these keys alone. Rows with a null key match nothing and are kept
out of the shuffle.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartlake.session import materialize

# Rows of one key that one task may take.
HOT_ROWS = 2_000_000
# Hot keys that are broadcast; more of them are joined as Spark decides.
BROADCAST_KEYS = 500_000


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows and the number of salts (``_salts``) for each."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot_rows)
    return counts.select(*keys, F.ceil(F.col("_rows") / F.lit(float(hot_rows))).cast("int").alias("_salts"))


def has_keys(keys: Sequence[str]) -> Column:
    return reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])


def _without_match(nulls: DataFrame, small: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    if how == "left_anti":
        return nulls
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in small.schema.fields if f.name not in keys]
    return nulls.select(*keys, *[c for c in nulls.columns if c not in keys], *rest)


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """``big.join(small, keys, how)`` with hot keys of ``big`` spread over tasks.

    ``how`` is inner, left, left_semi or left_anti. Hot keys are counted by a job of
    their own, once, while the join is being built (and ``big`` is read for it, so give
    a stored frame, or ``counted``); without any the join is a plain one. The salt is a hash of the
    row, so a repeated task computes the same one. ``counted`` is a cheaper frame
    with the keys of ``big`` (at least as many rows per key) to find hot keys in.
    """
    keys = list(keys)
    known = big.where(has_keys(keys))
    hot = materialize(hot_keys((big if counted is None else counted).where(has_keys(keys)), keys, hot_rows))
    found = hot.count()
    if found:
        hot = F.broadcast(hot) if found <= BROADCAST_KEYS else hot
        spread = F.pmod(F.xxhash64(*big.columns), F.col("_salts").cast("long"))
        left = known.join(hot, keys, "left").withColumn("_salt", F.coalesce(spread, F.lit(0).cast("long"))).drop("_salts")
        copies = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
        right = small.join(hot, keys, "left").withColumn("_salt", F.explode(copies.cast("array<bigint>"))).drop("_salts")
        out = left.join(right, [*keys, "_salt"], how).drop("_salt")
    else:
        out = known.join(small, keys, how)
    if how in ("inner", "left_semi"):
        return out
    return out.unionByName(_without_match(big.where(~has_keys(keys)), small, keys, how))
