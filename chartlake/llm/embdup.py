"""Near-duplicate embeddings: subspace pigeonhole join.

Two unit vectors with cosine >= t are at squared distance <= 2 - 2t. After a random
rotation the axes are cut into blocks; with the distance budget shared in proportion
to the block sizes, at least one block keeps its share. Each block is range-joined on
a grid over its first axes whose cells are as wide as the block's radius: a vector
goes to its cell and to the half of the neighbour cells that lie before it. In a cell
the block distances of home rows against home rows and guests are a matrix product;
what stays within budget is verified with the exact cosine in double precision.

A pair may be found in several blocks; it belongs to the first block within budget, so
links are counted once without gathering pairs. Every task comes to the same decision:
rotated vectors are made once, stored as integers of ``UNIT`` steps, and block distances
are integers too. Tasks give counts and a spanning forest of their links, not pairs.
A cell with very many rows is dealt to several tasks: part of its home rows each,
against all rows after them. Equal vectors are one vector with a number of copies.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components have no link and are their own component; vectors of different lengths
don't link; repeated rows count as other vectors; a null id is not compared.
"""
from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartlake.llm import textkernels as tk
from chartlake.llm.graphs import components
from chartlake.session import materialize

THRESHOLD = 0.95
BLOCKS = 6
GRID_AXES = 2
#: Home rows of a cell in one task.
HOME_ROWS = 16_384
#: Rows compared with the home rows at once.
CHUNK = 512
#: Steps of a rotated component in one.
UNIT = 1 << 20
#: Added to squared budgets; more than the rounding of rotated components can take away.
SLACK = 3e-5


def is_usable(x: Column) -> Column:
    """True for vectors that can have a direction."""
    finite = F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda c: c != 0), F.lit(False))


def valid_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id`` and ``v``, the components as bytes of doubles, of the usable rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("x")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<f8") + 0.0  # -0.0 becomes 0.0
            edges = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            packed = [flat[a:b].tobytes() for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(packed, pa.binary())], ["vec_id", "v"])

    usable = is_usable(F.col(vector)) & F.col("vec_id").isNotNull()
    return rows.where(usable).select("vec_id", F.col(vector).alias("x")).mapInArrow(pack, "vec_id long, v binary")


def rotation(size: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(size).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def rotated(x: np.ndarray) -> np.ndarray:
    """Rotated unit vectors, in integer steps."""
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return np.rint((x / np.sqrt((x * x).sum(1, keepdims=True))) @ rotation(x.shape[1]) * UNIT).astype("<i4")


def with_rotation(distinct: DataFrame) -> DataFrame:
    """``v``, ``rep``, ``copies`` and ``turned``, the rotated vector (32-bit integers as bytes)."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("v").to_pylist()
            lengths = np.array([len(v) // 8 for v in values])
            out = [b""] * len(values)
            for size in np.unique(lengths):
                some = np.flatnonzero(lengths == size)
                x = np.frombuffer(b"".join(values[i] for i in some), "<f8").reshape(len(some), size)
                for i, row in zip(some, rotated(x)):
                    out[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], ["v", "rep", "copies", "turned"])

    return distinct.select("v", "rep", "copies").mapInArrow(turn, "v binary, rep long, copies long, turned binary")


def cuts(size: int, blocks: int, threshold: float) -> list[tuple[int, int, int]]:
    """First axis, end and squared-distance budget (in squared steps) of each block."""
    edges = np.linspace(0, size, min(blocks, size) + 1).round().astype(int)
    return [(a, b, int(((2 - 2 * threshold) * (b - a) / size + SLACK) * UNIT**2)) for a, b in zip(edges, edges[1:])]


def cells(distinct: DataFrame, threshold: float, blocks: int, axes: int) -> DataFrame:
    """``rep``, ``size``, ``block``, ``cell`` and ``guest`` (0 in the own cell, else 1)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ids = batch.column("turned").to_pylist(), batch.column("rep").to_numpy()
            lengths = np.array([len(v) // 4 for v in values])
            for size in np.unique(lengths):
                some = np.flatnonzero(lengths == size)
                x = np.frombuffer(b"".join(values[i] for i in some), "<i4").reshape(len(some), size).astype(np.int64)
                for number, (a, b, budget) in enumerate(cuts(size, blocks, threshold)):
                    dims = min(axes, b - a)
                    grid = x[:, a : a + dims] // (math.isqrt(budget) + 1) + (1 << 20)
                    for step in itertools.product((-1, 0, 1), repeat=dims):
                        if step > (0,) * dims:
                            continue  # the other half comes to us
                        cell = np.zeros(len(some), np.int64)
                        for k in range(dims):
                            cell = (cell << 21) + grid[:, k] + step[k]
                        same = [np.full(len(some), c) for c in (size, number, int(any(step)))]
                        columns = [pa.array(c, pa.int64()) for c in (ids[some], same[0], same[1], cell, same[2])]
                        yield pa.RecordBatch.from_arrays(columns, ["rep", "size", "block", "cell", "guest"])

    return distinct.select("rep", "turned").mapInArrow(place, "rep long, size long, block long, cell long, guest long")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links with the smallest node it is connected to here."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = places[: len(a)], places[len(a) :]
    label = np.arange(len(nodes))
    while True:
        old, low = label.copy(), np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == old).all():
            return nodes, nodes[label]


class Cell:
    """Home rows of one unit of work; compares further rows with them."""

    def __init__(self, block: int, size: int, threshold: float, blocks: int):
        self.cuts, self.block, self.threshold = cuts(size, blocks, threshold), block, threshold
        self.parts: list[tuple] = []
        self.home: tuple | None = None

    def read(self, rows: pa.Table) -> tuple:
        values = rows.column("v").to_pylist()
        x = np.frombuffer(b"".join(values), "<f8").reshape(len(values), -1)
        x = x / np.abs(x).max(1, keepdims=True)
        turned = np.frombuffer(b"".join(rows.column("turned").to_pylist()), "<i4").reshape(len(values), -1)
        return rows.column("rep").to_numpy(), rows.column("copies").to_numpy(), x, np.sqrt((x * x).sum(1)), turned

    def compare(self, ids, copies, x, norm, turned, among: int | None = None):
        """Links of the given rows with the home rows; ``among``: place of these rows in the home rows."""
        hid, hcopies, hx, hnorm, hturned = self.home
        a, b, budget = self.cuts[self.block]
        p, q = (t[:, a:b].astype(np.float32) / np.float32(UNIT) for t in (turned, hturned))
        far = (p * p).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * (p @ q.T)
        i, j = np.nonzero(far <= budget / UNIT**2 + 1e-4)
        if among is not None:
            later = j > i + among
            i, j = i[later], j[later]
        found = []
        for at in range(0, len(i), 65_536):
            u, w = i[at : at + 65_536], j[at : at + 65_536]
            gap = (turned[u].astype(np.int64) - hturned[w]) ** 2
            within = np.stack([gap[:, s:e].sum(1) <= limit for s, e, limit in self.cuts[: self.block + 1]])
            mine = within[-1] & ~within[:-1].any(0)
            u, w = u[mine], w[mine]
            cosine = (x[u] * hx[w]).sum(1) / (norm[u] * hnorm[w])
            good = cosine >= self.threshold
            found.append((u[good], w[good]))
        if not found:
            return None
        u, w = (np.concatenate(c) for c in zip(*found))
        return (ids[u], hid[w], copies[u], hcopies[w]) if len(u) else None


def pair_links(units: DataFrame, threshold: float, blocks: int) -> DataFrame:
    """``a``, ``b``, ``n``: counts of links (b null) and forest links (n 0) of all units."""

    def emit(found) -> pa.RecordBatch:
        a, b, ca, cb = found
        nodes, root = forest(a, b)
        total = np.zeros(len(nodes), np.int64)
        np.add.at(total, np.searchsorted(nodes, a), cb)
        np.add.at(total, np.searchsorted(nodes, b), ca)
        tied = nodes != root
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([nodes, nodes[tied]])),
                pa.array([None] * len(nodes) + root[tied].tolist(), pa.int64()),
                pa.array(np.concatenate([total, np.zeros(tied.sum(), np.int64)])),
            ],
            ["a", "b", "n"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cell = None, None
        names = ["size", "block", "cell", "part", "guest"]

        def finish():
            """All home rows are here: compare them with each other."""
            if cell.home is None:
                cell.home = tuple(np.concatenate(c) for c in zip(*cell.parts))
                cell.parts = []
                for at in range(0, len(cell.home[0]), CHUNK):
                    found = cell.compare(*(c[at : at + CHUNK] for c in cell.home), among=at)
                    if found:
                        yield emit(found)

        for run in tk.groups(batches, names, joined=False):
            size, block, place, part, guest = (run.column(c)[0].as_py() for c in names)
            if (size, block, place, part) != key:
                if cell is not None and cell.parts:
                    yield from finish()
                key, cell = (size, block, place, part), Cell(block, size, threshold, blocks)
            if not guest:
                cell.parts.append(cell.read(run))
            elif cell.parts or cell.home is not None:
                yield from finish()
                rows = cell.read(run)
                for at in range(0, run.num_rows, CHUNK):
                    found = cell.compare(*(c[at : at + CHUNK] for c in rows))
                    if found:
                        yield emit(found)
        if cell is not None and cell.parts:
            yield from finish()

    keys = ["size", "block", "cell", "part"]
    dealt = units.repartition(*keys).sortWithinPartitions(*keys, "guest")
    return dealt.mapInArrow(work, "a long, b long, n long")


def near_vectors(
    rows: DataFrame, threshold: float = THRESHOLD, blocks: int = BLOCKS, axes: int = GRID_AXES, home_rows: int = HOME_ROWS
) -> DataFrame:
    """One row per row of ``rows``: ``vec_id``, ``n_links``, ``component_id``, ``kept``."""
    tk.arrow_batches(rows.sparkSession)
    usable = materialize(valid_vectors(rows))
    equal = usable.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    distinct = materialize(with_rotation(equal))
    placed = materialize(cells(distinct, threshold, blocks, axes))
    keys = ["size", "block", "cell"]
    large = placed.where("guest = 0").groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / home_rows).cast("int").alias("parts"))
    narrow = placed.join(large, keys)  # a cell without home rows has no work
    own = F.when(F.col("guest") == 0, F.pmod(F.xxhash64("rep"), F.col("parts"))).otherwise(F.col("parts"))
    narrow = narrow.withColumn("own", own.cast("int"))
    # A home row also meets, as a guest, the home rows of the parts before its own.
    last = F.least("own", F.col("parts") - 1)
    spread = narrow.withColumn("part", F.explode(F.sequence(F.lit(0), last)))
    spread = spread.withColumn("guest", F.when(F.col("part") == F.col("own"), 0).otherwise(1))
    units = spread.select("rep", *keys, "part", "guest").join(distinct, "rep")
    found = materialize(pair_links(units, threshold, blocks))
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    joined = components(found.where("b is not null").select("a", "b"))
    of = distinct.join(counts, F.col("rep") == F.col("a"), "left").drop("a")
    of = of.join(joined, F.col("rep") == F.col("node"), "left")
    links = (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    of = of.select("v", links, F.coalesce("component", "rep").alias("component_id"))
    linked = usable.join(of, "v").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    alone = rows.where(~(is_usable(F.col("embedding")) & F.col("vec_id").isNotNull()))
    alone = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    same = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    return linked.union(alone).withColumn("kept", same)
