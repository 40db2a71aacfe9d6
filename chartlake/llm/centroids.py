"""Centroid clustering of integer vectors by the threshold algorithm.

Component x becomes floor(scale * x). For every dimension the centroids stand in a
list sorted by their value there. A vector walks outward from its own value in all
lists at once, one centroid a step and list, the nearer side first. A centroid met for
the first time is compared exactly. The squared gaps of a step, summed over the lists,
bound the distance of every centroid not yet met; the walk stops once that sum is
strictly above the best distance, so an equally near centroid with a smaller number
is never missed.

Every round is one pass over the stored vectors: tasks give a count and a sum of
components for each centroid, the driver divides them exactly. Centroids (``k`` rows)
are all that is broadcast or sent to the driver; a round has no lineage to the former.

Defined results: only vectors with exactly ``dims`` components, none null or not
finite, take part, also without a vec_id, but these are no first centroids; components
of 2**27 or more after scaling take no part, as squared distances must fit a long.
Ties go to the smaller centroid number. Repeated rows count each; of first centroids
with one id the smaller vector is first. With fewer than ``k`` rows there are fewer
centroids, and none for an empty table. An empty cluster keeps its centroid. Other
columns don't pass.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartlake.llm import textkernels as tk
from chartlake.session import materialize

DIMS = 64
CENTROIDS = 40
ROUNDS = 5
SCALE = 256
#: Largest component after scaling, exclusive.
REACH = 2**27
#: Vectors that walk together.
CHUNK = 2048


def scaled(rows: DataFrame, dims: int = DIMS, scale: int = SCALE, vector: str = "embedding") -> DataFrame:
    """``vec_id`` and ``v`` (64-bit integers as bytes) of the rows that take part."""
    x = F.col(vector)
    small = F.forall(x, lambda c: c.isNotNull() & (F.abs(F.floor(c.cast("double") * scale)) < REACH))
    usable = x.isNotNull() & (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < float("inf"))) & small

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            whole = np.floor(scale * flat).astype("<i8").reshape(batch.num_rows, dims)
            packed = pa.array([v.tobytes() for v in whole], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), packed], ["vec_id", "v"])

    return rows.where(usable).select("vec_id", x.alias("x")).mapInArrow(pack, "vec_id long, v binary")


class Lists:
    """The centroids, and for each dimension their values in order."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable").T.copy()  # dims x k
        self.values = np.sort(centroids, axis=0).T.copy()

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of each row's nearest centroid, and how many were compared."""
        k, dims = self.centroids.shape
        n = len(x)
        every = np.arange(dims)
        best, who = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
        seen = np.zeros((n, k), bool)
        # Places of the next centroid to the right and to the left, in every list.
        right = np.stack([np.searchsorted(self.values[d], x[:, d]) for d in range(dims)], axis=1)
        left = right - 1
        rows, own, compared = np.arange(n), x, 0
        far = np.int64(4 * REACH)
        while len(rows):
            before = np.where(left >= 0, own - self.values[every, np.maximum(left, 0)], far)
            after = np.where(right < k, self.values[every, np.minimum(right, k - 1)] - own, far)
            ahead = after < before
            met = self.order[every, np.where(ahead, np.minimum(right, k - 1), np.maximum(left, 0))]
            gap = np.minimum(before, after)
            right, left = right + ahead, left - ~ahead
            fresh = np.zeros((len(rows), k), bool)
            fresh[np.arange(len(rows))[:, None], met] = True
            fresh &= ~seen
            seen |= fresh
            for c in np.flatnonzero(fresh.any(0)):
                some = np.flatnonzero(fresh[:, c])
                distance = ((own[some] - self.centroids[c]) ** 2).sum(1)
                compared += len(some)
                at = rows[some]
                nearer = (distance < best[at]) | ((distance == best[at]) & (c < who[at]))
                best[at[nearer]], who[at[nearer]] = distance[nearer], c
            # A row that has met all centroids has none left to bound.
            live = ((gap * gap).sum(1) <= best[rows]) & ~seen.all(1)
            rows, own, seen, right, left = rows[live], own[live], seen[live], right[live], left[live]
        return who, best, compared


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), dims)


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id``, ``cluster`` and ``distance`` (squared) of packed vectors."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                who, best, _ = lists.nearest(_matrix(part.column("v"), shared.value.shape[1]))
                columns = [part.column("vec_id"), pa.array(who, pa.int32()), pa.array(best)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "v").mapInArrow(work, "vec_id long, cluster int, distance long")


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: floors of the exact means, empty ones unchanged."""
    k, dims = centroids.shape
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(shared.value)
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                x = _matrix(batch.column("v").slice(at, CHUNK), dims)
                who, _, _ = lists.nearest(x)
                np.add.at(sums, who, x)
                counts += np.bincount(who, minlength=k)
        cells = [np.repeat(np.arange(k), dims), np.tile(np.arange(dims), k), np.repeat(counts, dims), sums.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["cluster", "dim", "n", "total"])

    parts = vectors.select("v").mapInArrow(total, "cluster long, dim long, n long, total long")
    found = parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0")
    result = centroids.copy()
    for r in found.collect():  # at most one row for each component of each centroid
        result[r.cluster, r.dim] = r.total // r.n
    return result


def first_centroids(vectors: DataFrame, order: Column, k: int, dims: int) -> np.ndarray:
    """The ``k`` vectors with the smallest ``order`` (not null), in that order."""
    chosen = vectors.withColumn("_order", order).where("_order is not null").orderBy("_order", "v").limit(k)
    rows = chosen.select("_order", "v").collect()
    rows.sort(key=lambda r: (r["_order"], bytes(r["v"])))
    return np.frombuffer(b"".join(bytes(r["v"]) for r in rows), "<i8").reshape(len(rows), dims).copy()


def cluster_vectors(
    rows: DataFrame,
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    dims: int = DIMS,
    scale: int = SCALE,
    salt: str = "2:",
) -> tuple[DataFrame, DataFrame]:
    """The vectors with their cluster, and the clusters.

    The first frame has ``vec_id``, ``cluster`` and ``distance``; the second, of at most
    ``k`` rows, ``cluster``, ``centroid`` (its components), ``size`` and ``inertia``.
    First centroids are the vectors whose sha256 of ``salt`` and id is smallest.
    """
    spark = rows.sparkSession
    tk.arrow_batches(spark)
    vectors = materialize(scaled(rows, dims, scale))
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    centroids = first_centroids(vectors, order, k, dims)
    layout = "cluster int, centroid array<long>, size long, inertia long"
    if not len(centroids):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("false"), (
            spark.createDataFrame([], layout)
        )
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    assigned = materialize(assign(vectors, centroids))
    sums = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum("distance").alias("inertia"))
    known = {r["cluster"]: (r["size"], r["inertia"]) for r in sums.collect()}
    table = [(c, [int(x) for x in v], *known.get(c, (0, 0))) for c, v in enumerate(centroids)]
    return assigned, spark.createDataFrame(table, layout)


def digest(assigned: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row per vector with its cluster's inertia, the whole inertia and the hash of its centroid."""
    total = clusters.agg(F.sum("inertia").alias("inertia")).first()["inertia"]
    text = F.concat_ws(",", F.transform("centroid", lambda c: c.cast("string")))
    about = clusters.select("cluster", F.col("inertia").alias("cluster_inertia"), F.sha2(text, 256).alias("centroid_sha256"))
    out = assigned.join(F.broadcast(about), "cluster")  # one row per centroid
    return out.select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256"
    )

