"""Connected components of a link table, as joins and grouped minima."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartlake.session import materialize


def _mark(edges: DataFrame) -> tuple:
    """Size and checksum of a set of links: one row for the driver."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node with a link.

    ``links`` has columns ``a`` and ``b``. Alternates two steps until nothing changes:
    all larger neighbours of a node, then all smaller ones, are linked to the smallest
    neighbour. The number of steps grows with the logarithm of the longest path; no
    neighbour list is ever gathered. Each step is stored in the shared folder.
    """
    large, small = F.greatest("a", "b"), F.least("a", "b")
    edges = links.where(F.col("a") != F.col("b")).select(large.alias("a"), small.alias("b")).distinct()
    edges = materialize(edges)
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        wide = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        wide = wide.distinct()
        least = wide.groupBy("a").agg(F.min("b").alias("m"))
        near = wide.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = materialize(near.union(least.select("a", F.col("m").alias("b"))).distinct())
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
