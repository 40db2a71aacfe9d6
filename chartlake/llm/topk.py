"""Exact top-k inner products by dual-tree search over cover trees.

A cover tree is a sequence of nets with halving radii: the centers of a level are more
than its radius apart (separation), every point is within the radius of one
(covering), and the centers of a level are centers of the next (nesting). They are
taken in farthest-first order, in which a prefix is such a net for every radius. Each
node also has the exact radius around all points below it. For a query node Q and a
candidate node P no inner product exceeds <q,p> + r_Q|p| + r_P|q| + r_Q r_P; a pair of
nodes is dropped when that is below the worst kth score of the queries in Q.

The top of the tree is built on a bounded sample: its centers are anchors, to which all
candidates and queries are dealt by distance; how far an anchor's candidates reach is
then computed from all of them. The sample's scores give each query a first kth score,
and a group of queries visits only anchors whose bound reaches it. Under an anchor,
parts of bounded size have trees of their own, and so have the queries that come to
them. The parts' lists are merged by a ranking per query that keeps k rows on each side
of the shuffle.

Components become floor(scale * x). Scores are integers: products of doubles where all
sums stay below 2**53, and of 64-bit integers otherwise (a score must fit a long).

Defined results: vectors that are null, empty or hold null or non-finite components
take no part; vectors of different lengths aren't compared; ties go to the smaller
vec_id; a query has fewer rows if there are fewer candidates; repeated candidate rows
count each, repeated query rows once; a null id takes no part.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartlake.llm import textkernels as tk
from chartlake.session import materialize

SCALE = 1024
#: Candidates in one task's tree, queries in one query tree.
CANDIDATE_ROWS = 8192
QUERY_ROWS = 1024
#: Rows that the top of the tree is built on, and anchors taken from it.
SAMPLE_ROWS = 2048
ANCHORS = 64
#: A tree has at most one center for so many points: candidates, queries.
LEAF = 16
QUERY_LEAF = 2
#: Candidates scored at once with a group of queries.
CHUNK = 2048
NO_SCORE = np.iinfo(np.int64).min


def quantized(rows: DataFrame, scale: int = SCALE, vector: str = "embedding") -> DataFrame:
    """``vec_id``, ``size`` and ``v`` (64-bit integers as bytes) of the usable rows."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    usable = F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("x")
            flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype("<i8")
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            edges = np.concatenate([[0], np.cumsum(size)])
            packed = [flat[a:b].tobytes() for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(size), pa.array(packed, pa.binary())], ["vec_id", "size", "v"]
            )

    return rows.where(usable).select("vec_id", x.alias("x")).mapInArrow(pack, "vec_id long, size long, v binary")


@dataclass(frozen=True)
class Level:
    """One net: points that are its centers, their places in the level above, and how far the points below reach."""

    radius: float
    centers: np.ndarray
    parent: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray
    reach: np.ndarray


class CoverTree:
    """Nets over integer vectors from a single root downwards; ``members`` are the points of the last net's nodes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        x = points.astype(np.float64)
        order, spacing, rest = self._farthest_first(x, max(1, -(-len(x) // leaf)))
        # The last net needs a radius that still covers every point, and centers farther apart.
        last = math.ceil(math.log2(rest)) if rest > 0 else (math.ceil(math.log2(spacing[-1])) - 1 if len(order) > 1 else 0)
        top = max(last, math.ceil(math.log2(spacing[1])) if len(order) > 1 else last)
        self.levels: list[Level] = []
        nets = [(2.0**i, int((spacing > 2.0**i).sum())) for i in range(top, last - 1, -1)]
        nets = [net for i, net in enumerate(nets) if i in (0, len(nets) - 1) or net[1] > nets[i - 1][1]]
        own = self._nearest(x, x[order[: nets[-1][1]]])  # bottom node of each point
        self.members = np.split(np.argsort(own, kind="stable"), np.cumsum(np.bincount(own, minlength=nets[-1][1]))[:-1])
        # Parents, from the root to the last net; then radii, from what lies below.
        parents = [np.zeros(nets[0][1], np.int64)]
        for (_, above), (_, count) in zip(nets, nets[1:]):
            near = self._nearest(x[order[:count]], x[order[:above]])
            near[:above] = np.arange(above)  # a center of the level above is its own parent
            parents.append(near)
        below = own
        for (radius, count), parent in zip(nets[::-1], parents[::-1]):
            centers = x[order[:count]]
            far = np.sqrt(((x - centers[below]) ** 2).sum(1))
            reach = np.zeros(count)
            np.maximum.at(reach, below, far)
            norms = np.sqrt((centers**2).sum(1))
            # Rounding must not make a radius too small.
            self.levels.append(Level(radius, order[:count], parent, centers, norms, reach * (1 + 1e-9) + 1e-6))
            below = parent[below]
        self.levels.reverse()

    @staticmethod
    def _farthest_first(x: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, float]:
        """Points in farthest-first order, the distance of each to those before it, and of the next one."""
        order = [int(((x - x.mean(0)) ** 2).sum(1).argmin())]
        spacing, near = [math.inf], ((x - x[order[0]]) ** 2).sum(1)
        while len(order) < limit and near.max() > 0:
            order.append(int(near.argmax()))
            spacing.append(math.sqrt(near[order[-1]]))
            near = np.minimum(near, ((x - x[order[-1]]) ** 2).sum(1))
        return np.array(order), np.array(spacing), math.sqrt(near.max())

    @staticmethod
    def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
        best, who = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
        for c, center in enumerate(centers):
            far = ((x - center) ** 2).sum(1)
            nearer = far < best
            best[nearer], who[nearer] = far[nearer], c
        return who


def bounds(q: np.ndarray, q_norm: np.ndarray, q_reach: np.ndarray, p: np.ndarray, p_norm: np.ndarray, p_reach: np.ndarray) -> np.ndarray:
    """Most that an inner product can be between points around q and points around p."""
    most = q @ p.T + q_reach[:, None] * p_norm[None, :] + q_norm[:, None] * p_reach[None, :] + q_reach[:, None] * p_reach[None, :]
    return most + np.abs(most) * 1e-9 + 1e-3


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    reach = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if reach < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Search:
    """Top k of queries in one tree of candidates."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, k: int):
        self.ids, self.points, self.k, self.tree = ids, points, k, CoverTree(points)

    def run(self, query_ids: np.ndarray, queries: np.ndarray, worst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query places, candidate places and scores; only scores that reach ``worst`` of their query count."""
        n = len(queries)
        self.query_ids, self.queries, self.worst = query_ids, queries, worst.copy()
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n  # places, scores
        own = CoverTree(queries, QUERY_LEAF)
        alive, bound = self._descend(own)
        for node, group in enumerate(own.members):
            self._visit(group, alive[node], bound[node])
        places, scores = zip(*self.best)
        return np.repeat(np.arange(n), [len(p) for p in places]), np.concatenate(places), np.concatenate(scores)

    def _descend(self, own: CoverTree) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of bottom nodes that can matter, and their bounds: both trees go down together."""
        least = []  # the worst kth score below each query node, level by level
        low = np.array([self.worst[group].min() for group in own.members])
        for level in own.levels[::-1]:
            least.append(low)
            above = np.full(int(level.parent.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(above, level.parent, low)
            low = above
        least.reverse()
        alive, q, p = np.ones((1, 1), bool), -1, -1
        while q < len(own.levels) - 1 or p < len(self.tree.levels) - 1:
            if q < len(own.levels) - 1:
                q += 1
                alive = alive[own.levels[q].parent] if q else np.ones((len(own.levels[0].centers), alive.shape[1]), bool)
            if p < len(self.tree.levels) - 1:
                p += 1
                alive = alive[:, self.tree.levels[p].parent] if p else np.ones((len(alive), len(self.tree.levels[0].centers)), bool)
            a, b = own.levels[q], self.tree.levels[p]
            bound = bounds(a.vectors, a.norms, a.reach, b.vectors, b.norms, b.reach)
            alive = alive & (bound >= least[q][:, None])
        return alive, bound

    def _visit(self, group: np.ndarray, alive: np.ndarray, bound: np.ndarray) -> None:
        """Score the candidates of the nodes that are left, from the highest bound down."""
        nodes = np.flatnonzero(alive)
        nodes = nodes[np.argsort(-bound[nodes], kind="stable")]
        at = 0
        while at < len(nodes) and bound[nodes[at]] >= self.worst[group].min():
            rows, end = 0, at
            while end < len(nodes) and rows < CHUNK:
                rows += len(self.tree.members[nodes[end]])
                end += 1
            self._score(group, np.concatenate([self.tree.members[i] for i in nodes[at:end]]))
            at = end

    def _score(self, group: np.ndarray, members: np.ndarray) -> None:
        scores = products(self.queries[group], self.points[members])
        for row, q in enumerate(group):
            good = (scores[row] >= self.worst[q]) & (self.ids[members] != self.query_ids[q])
            if not good.any():
                continue
            places = np.concatenate([self.best[q][0], members[good]])
            values = np.concatenate([self.best[q][1], scores[row][good]])
            order = np.lexsort((self.ids[places], -values))[: self.k]
            self.best[q] = (places[order], values[order])
            if len(order) == self.k:
                self.worst[q] = max(self.worst[q], values[order[-1]])


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), size)


def tree_top(stored: DataFrame, rows: int = SAMPLE_ROWS, anchors: int = ANCHORS) -> dict:
    """By vector length: ids and vectors of the sample, and the anchors (centers of its cover tree)."""
    narrow = stored.select("size", "vec_id", "v").withColumn("_order", F.xxhash64("vec_id", "v"))
    found: dict[int, list] = {}
    for r in narrow.orderBy("_order", "vec_id", "v").limit(rows).collect():
        found.setdefault(r["size"], []).append((r["vec_id"], bytes(r["v"])))
    top = {}
    for size, some in found.items():
        points = np.frombuffer(b"".join(v for _, v in some), "<i8").reshape(len(some), size)
        levels = CoverTree(points, 1).levels
        net = [level for level in levels if len(level.centers) <= anchors][-1]
        top[size] = (np.array([i for i, _ in some]), points, net.vectors)
    return top


def with_anchor(stored: DataFrame, top: dict, k: int) -> DataFrame:
    """``stored`` (with ``query``) plus its nearest ``anchor`` (-1 if its length has none), the distance
    ``far`` and, for queries, a score that the kth is known to reach (``worst``)."""
    shared = stored.sparkSession.sparkContext.broadcast(top)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            ids, asks = batch.column("vec_id").to_numpy(), batch.column("query").to_numpy(zero_copy_only=False)
            anchor, far = np.full(len(sizes), -1, np.int64), np.zeros(len(sizes))
            worst = np.full(len(sizes), NO_SCORE)
            for size in np.unique(sizes):
                if size not in shared.value:
                    continue
                some = np.flatnonzero(sizes == size)
                points = matrix(batch.column("v").take(pa.array(some)), size)
                sample_ids, sample, centers = shared.value[size]
                gap = np.stack([((points - c) ** 2).sum(1) for c in centers])
                anchor[some], far[some] = gap.argmin(0), np.sqrt(gap.min(0))
                mine = np.flatnonzero(asks[some])
                if len(mine):
                    scores = products(points[mine], sample)
                    for row, q in zip(scores, some[mine]):
                        others = row[sample_ids != ids[q]]
                        if len(others) >= k:
                            worst[q] = np.partition(others, len(others) - k)[len(others) - k]
            columns = [*batch.columns, pa.array(anchor), pa.array(far), pa.array(worst)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "anchor", "far", "worst"])

    return stored.select("vec_id", "size", "v", "query").mapInArrow(
        place, "vec_id long, size long, v binary, query boolean, anchor long, far double, worst long"
    )


def routed(asked: DataFrame, top: dict, reach: dict) -> DataFrame:
    """A row of ``asked`` for every anchor that can hold one of its k best.

    Queries of one anchor are a group with a common bound; what passes is tested for
    each query. ``reach``: by (size, anchor) how far the anchor's candidates are.
    """
    shared = asked.sparkSession.sparkContext.broadcast((top, reach))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, reach = shared.value
        for batch in batches:
            sizes, home = batch.column("size").to_numpy(), batch.column("anchor").to_numpy()
            worst, far = batch.column("worst").to_numpy(), batch.column("far").to_numpy()
            rows, anchors = [], []
            for size in np.unique(sizes):
                if size not in top:
                    rows.append(np.flatnonzero(sizes == size))
                    anchors.append(np.full(len(rows[-1]), -1))
                    continue
                held = np.array(sorted(a for s, a in reach if s == size and a >= 0), np.int64)
                centers = top[size][2].astype(np.float64)
                around = np.array([reach[size, a] for a in held]) * (1 + 1e-9) + 1e-6
                norms = np.sqrt((centers**2).sum(1))
                for group in np.unique(home[sizes == size]):
                    some = np.flatnonzero((sizes == size) & (home == group))
                    wide = np.array([far[some].max() * (1 + 1e-9) + 1e-6])
                    most = bounds(centers[[group]], norms[[group]], wide, centers[held], norms[held], around)[0]
                    open_ = held[most >= worst[some].min()]
                    points = matrix(batch.column("v").take(pa.array(some)), size).astype(np.float64)
                    at = np.searchsorted(held, open_)
                    own = bounds(points, np.sqrt((points**2).sum(1)), np.zeros(len(some)), centers[open_], norms[open_], around[at])
                    q, a = np.nonzero(own >= worst[some][:, None])
                    rows.append(some[q]), anchors.append(open_[a])
            take = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            out = batch.take(pa.array(take))
            to = pa.array(np.concatenate(anchors) if anchors else take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [out.column("vec_id"), out.column("size"), out.column("v"), to, out.column("worst")], ["vec_id", "size", "v", "anchor", "worst"]
            )

    narrow = asked.select("vec_id", "size", "v", "anchor", "far", "worst")
    return narrow.mapInArrow(route, "vec_id long, size long, v binary, anchor long, worst long")


def top_k(
    rows: DataFrame, is_query: Column, k: int = 10, scale: int = SCALE, candidate_rows: int = CANDIDATE_ROWS,
    sample_rows: int = SAMPLE_ROWS, anchors: int = ANCHORS,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k best candidates of each query row."""
    tk.arrow_batches(rows.sparkSession)
    stored = materialize(quantized(rows, scale).withColumn("query", F.coalesce(is_query, F.lit(False))))
    top = tree_top(stored, sample_rows, anchors)
    placed = materialize(with_anchor(stored, top, k))
    held = placed.groupBy("size", "anchor").agg(F.count(F.lit(1)).alias("rows"), F.max("far").alias("reach"))
    held = materialize(held.withColumn("parts", F.ceil(F.col("rows") / candidate_rows).cast("long")))
    # At most ``anchors`` rows for each vector length of the sample.
    reach = {(r["size"], r["anchor"]): r["reach"] for r in held.where("anchor >= 0").collect()}
    parts = held.select("size", "anchor", "parts")
    units = ["size", "anchor", "part", "query", "vec_id", "v", "worst"]
    numbered = placed.withColumn("_row", F.monotonically_increasing_id())  # of a stored table
    dealt = numbered.join(parts, ["size", "anchor"]).withColumn("part", F.pmod("_row", "parts"))
    dealt = dealt.withColumn("query", F.lit(0))
    asked = routed(placed.where("query").dropDuplicates(["vec_id", "v"]), top, reach).join(parts, ["size", "anchor"])
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    asked = asked.withColumn("query", F.lit(1))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, found = None, [], None
        for run in tk.groups(batches, ["size", "anchor", "part", "query"], joined=False):
            size, anchor, part, query = (run.column(c)[0].as_py() for c in ("size", "anchor", "part", "query"))
            if (size, anchor, part) != key:
                key, held, found = (size, anchor, part), [], None
            ids, points = run.column("vec_id").to_numpy(), matrix(run.column("v"), size)
            if not query:
                held.append((ids, points))
                continue
            if found is None:
                if not held:
                    continue
                found = Search(*(np.concatenate(c) for c in zip(*held)), k)
            worst = run.column("worst").to_numpy()
            for at in range(0, len(ids), QUERY_ROWS):
                some = slice(at, at + QUERY_ROWS)
                q, p, s = found.run(ids[some], points[some], worst[some])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[some][q]), pa.array(found.ids[p]), pa.array(s)], ["query_id", "vec_id", "score"]
                )

    spread = dealt.select(units).union(asked.select(units)).repartition("size", "anchor", "part")
    spread = spread.sortWithinPartitions("size", "anchor", "part", "query")
    lists = spread.mapInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return lists.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
