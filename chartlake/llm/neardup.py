"""Near-duplicate documents by ProbMinHash, banding and exact verification.

1. Every whole text becomes a weighted set of shingles of five words; the weight of
   a shingle is 1 + ln(occurrences). Each shingle is a Poisson process of that rate
   whose arrivals fall on random components of the signature; a component keeps its
   earliest arrival, and a process stops once it is later than all of them. Two
   signatures agree in a component with the probability Jaccard similarity.
   A text that repeats a shingle has a second signature with all weights 1, whose
   components agree with the Jaccard similarity of the sets, the measure of step 3;
   for other texts the two are the same.
2. Texts with the same words are one node. Nodes that agree on a whole band (5
   components of 130, 26 bands) of either signature share a bucket; a pair whose sets
   are at 0.8 is missed with probability (1 - 0.8**5)**26 = 3e-5, however often
   one of the texts repeats a passage.
3. Every member of a bucket is verified against the bucket's smallest node: a link is
   an exact Jaccard similarity of the shingle sets of at least 0.8.
4. Buckets that still hold several classes are searched once more, all members of
   different classes against each other, block by block; a block pair has bounded
   size, and only verified links leave it. So no link between candidates is lost
   although pairs inside a class are not expanded.
5. Classes are the connected components of the links.

Defined results: a text without words (null, empty, only punctuation) is a class of
its own; a row without doc_id gets class null and is kept; rows with one doc_id are
one document, also with different texts: all of them are in its class, with the copies
of each; ties (equal texts) go to the smallest doc_id; other columns pass. ``one_of_each``
keeps texts rather than documents: there different texts of one doc_id are apart.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartlake.llm import textkernels as tk
from chartlake.llm.graphs import components
from chartlake.operators.skew import salted_join
from chartlake.session import materialize

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS = 26
BAND_ROWS = 5
#: Members of one bucket compared in one task, on each side.
BLOCK_ROWS = 1024
#: Shingles of these members that one side should hold at most.
BLOCK_SHINGLES = 4_000_000


def weighted_shingles(data: np.ndarray, offsets: np.ndarray, words: int = SHINGLE_WORDS):
    """Distinct shingles (sorted in each text), their text index and occurrences, and the words."""
    texts = len(offsets) - 1
    hashes, owner, _ = tk.word_hashes(data, offsets)
    sh, of = tk.shingles(hashes, owner, texts, words)
    order = np.argsort(sh)
    order = order[np.argsort(of[order], kind="stable")]
    sh, of = sh[order], of[order]
    first = np.ones(len(sh), bool)
    first[1:] = (sh[1:] != sh[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(first)
    return sh[at], of[at], np.diff(np.append(at, len(sh))), hashes, owner


def prob_minhash(sh: np.ndarray, owner: np.ndarray, weight: np.ndarray, texts: int, size: int) -> np.ndarray:
    """Signatures (texts x size): the shingle that arrives first at each component."""
    best = np.full(texts * size, np.inf)
    winner = np.zeros(texts * size, np.uint64)
    time = np.zeros(len(sh))
    step = 0
    while len(sh):
        ahead = 1 if len(sh) > 4096 else 16  # arrivals drawn at once
        salt = (np.arange(step, step + ahead, dtype=np.uint64) + np.uint64(1)) * np.uint64(tk.ODD)
        h = tk.mix(sh[:, None] ^ tk.mix(salt)[None, :])
        gap = -np.log(((h >> np.uint64(16)).astype(np.float64) + 0.5) * 2.0**-48) / weight[:, None]
        at = time[:, None] + np.cumsum(gap, axis=1)
        part = ((h & np.uint64(0xFFFF)) * np.uint64(size) >> np.uint64(16)).astype(np.int64)
        flat, when = (part + (owner * size)[:, None]).ravel(), at.ravel()
        np.minimum.at(best, flat, when)
        hit = when == best[flat]
        winner[flat[hit]] = np.repeat(sh, ahead)[hit]
        time, step = at[:, -1], step + ahead
        last = best.reshape(texts, size).max(1)
        live = time < last[owner]
        sh, owner, weight, time = sh[live], owner[live], weight[live], time[live]
    return winner.reshape(texts, size)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    factor = np.cumprod(np.full(rows, tk.ODD, np.uint64))
    grouped = signature[:, : bands * rows].reshape(-1, bands, rows)
    return tk.mix((grouped * factor).sum(2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)).view(np.int64)


def bucket_keys(sh: np.ndarray, owner: np.ndarray, count: np.ndarray, texts: int, bands: int, rows: int):
    """Distinct band keys of the weighted and the unit-weight signature of each text, and their text index."""
    keys = band_keys(prob_minhash(sh, owner, 1 + np.log(count), texts, bands * rows), bands, rows)
    again = np.unique(owner[count > 1])  # without repeats all weights are 1
    mine = np.isin(owner, again)
    plain = prob_minhash(sh[mine], np.searchsorted(again, owner[mine]), np.ones(mine.sum()), len(again), bands * rows)
    of = np.repeat(np.concatenate([np.arange(texts), again]), bands)
    keys = np.concatenate([keys.ravel(), band_keys(plain, bands, rows).ravel()])
    order = np.lexsort((keys, of))
    keys, of = keys[order], of[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
    return keys[first], of[first]


def _per_text(values: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    total = np.zeros(texts, np.uint64)
    np.add.at(total, owner, values)
    return tk.mix(total).view(np.int64)


def content_hash(hashes: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the word sequence of each text."""
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    one = tk.mix(hashes + place.astype(np.uint64) * np.uint64(tk.ODD))
    two = tk.mix(one ^ np.uint64(0x5851F42D4C957F2D))
    return _per_text(one, owner, texts), _per_text(two, owner, texts)


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = BAND_ROWS, words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id``, two content hashes, the number of distinct shingles and the band keys of each row."""
    tk.arrow_batches(docs.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.drop_words()
        for batch in batches:
            for part in tk.slices(batch, "text"):
                texts = part.num_rows
                sh, of, count, hashes, owner = weighted_shingles(*tk.text_bytes(part.column("text")), words)
                keys, has = bucket_keys(sh, of, count, texts, bands, rows)
                one, two = content_hash(hashes, owner, texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(one), pa.array(two),
                        pa.array(np.bincount(of, minlength=texts)),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(has, np.arange(texts + 1)), pa.int32()), pa.array(keys)),
                    ],
                    ["doc_id", "c1", "c2", "n", "bands"],
                )

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, c1 long, c2 long, n long, bands array<long>")


def shingle_sets(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """``node``, the number ``n`` of its distinct shingles, and these, sorted, as bytes.

    Of ``docs`` only rows count whose text has the content hash ``c1``.
    """

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.drop_words()
        for batch in batches:
            for part in tk.slices(batch, "text"):
                sh, of, _, hashes, owner = weighted_shingles(*tk.text_bytes(part.column("text")), words)
                edges = np.searchsorted(of, np.arange(part.num_rows + 1))
                sets = [sh[a:b].tobytes() for a, b in zip(edges, edges[1:])]
                columns = [part.column("node"), pa.array(np.diff(edges), pa.int64()), pa.array(sets, pa.binary())]
                same = content_hash(hashes, owner, part.num_rows)[0] == part.column("c1").to_numpy()
                yield pa.RecordBatch.from_arrays(columns, ["node", "n", "shingles"]).filter(pa.array(same))

    return docs.select("node", "c1", "text").mapInArrow(collect, "node long, n long, shingles binary")


def _set(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint64)


def verify(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs ``a``, ``b`` whose shingle sets have at least the Jaccard similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.drop_words()
        for batch in batches:
            good = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = _set(x), _set(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= threshold * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(exact, "a long, b long")


def link_block(nodes: np.ndarray, classes: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], threshold: float):
    """Links between rows of different classes; with two sides, only across them.

    Each row is compared with all later ones at once: their shingles are looked up in
    its own. Classes that a link joins are not compared again.
    """
    n, links = len(nodes), []
    classes = classes.copy()
    size = np.array([len(s) for s in sets])
    edge = np.concatenate([[0], np.cumsum(size)])
    every, row = np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.repeat(np.arange(n), size)
    across = sides.min() != sides.max() if n else False
    for i in range(n - 1):
        rest = np.arange(i + 1, n)
        rest = rest[classes[rest] != classes[i]]
        if across:
            rest = rest[sides[rest] != sides[i]]
        rest = rest[(size[rest] >= threshold * size[i]) & (size[i] >= threshold * size[rest])]
        if not len(rest):
            continue
        if len(rest) * 4 > n - i:
            values, of = every[edge[i + 1] :], row[edge[i + 1] :]
        else:
            values, of = np.concatenate([sets[j] for j in rest]), np.repeat(rest, size[rest])
        found = np.searchsorted(sets[i], values)
        same = sets[i][np.minimum(found, len(sets[i]) - 1)] == values
        both = np.bincount(of[same], minlength=n)[rest]
        for j in rest[both >= threshold * (size[i] + size[rest] - both)]:
            if classes[j] != classes[i]:
                links.append((nodes[i], nodes[j]))
                classes[classes == classes[j]] = classes[i]
    return links


def search_blocks(members: DataFrame, sets: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK_ROWS) -> DataFrame:
    """Links between ``members`` of different components: ``bucket``, ``node``, ``component``,
    and of the bucket ``size`` (rows) and ``total`` (shingles).

    A bucket of more than ``block`` rows or very many shingles is dealt to blocks by a
    hash of the node, and every pair of its blocks is one unit of work; rows are repeated
    once per partner block, pairs are never emitted.
    """
    blocks = F.ceil(F.greatest(F.col("size") / block, F.col("total") / BLOCK_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    units = dealt.select("bucket", "i", "j", "own", "node", "component").join(sets.drop("n"), "node")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.drop_words()
        for unit in tk.groups(batches, ["bucket", "i", "j"]):
            column = {c: unit.column(c).to_numpy() for c in ("node", "component", "own")}
            sets_ = [_set(s) for s in unit.column("shingles")]
            links = link_block(column["node"], column["component"], column["own"], sets_, threshold)
            if links:
                a, b = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    spread = units.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")
    return spread.mapInArrow(search, "a long, b long")


def named_texts(signed: DataFrame) -> DataFrame:
    """``signed`` with the ``node`` of each row and ``first``, the smallest doc_id with its text.

    Equal texts are one node, numbered by ``first``. If that is the first of several
    texts, the others get a hash as number, which meets another node's number by chance
    only. ``bands`` stay in the rows that stand for their node.
    """
    # Stored, so that both sides of the joins are plain shuffles, whose hot keys (a text
    # with very many copies, a bucket with very many nodes) Spark splits.
    content = materialize(signed.where("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("first")))
    leads = content.groupBy("first").agg(F.min(F.struct("c1", "c2")).alias("_lead"), F.count(F.lit(1)).alias("_texts"))
    leads = materialize(leads.where("_texts > 1 and first is not null").select("first", "_lead"))
    if leads.isEmpty():
        content = content.withColumn("node", F.col("first"))
    else:
        other = F.col("_lead").isNotNull() & (F.col("_lead") != F.struct("c1", "c2"))
        number = F.when(other, F.xxhash64("first", "c1", "c2")).otherwise(F.col("first"))
        content = materialize(content.join(leads, "first", "left").select("c1", "c2", "first", number.alias("node")))
    named = signed.join(content, ["c1", "c2"], "left")
    named = named.withColumns({c: F.coalesce(c, "doc_id") for c in ("node", "first")})
    bands = F.when(F.col("doc_id") == F.col("first"), F.col("bands")).alias("bands")
    return materialize(named.select("doc_id", "c1", "c2", "n", "node", "first", bands))


def node_links(docs: DataFrame, named: DataFrame, threshold: float) -> DataFrame:
    """Links ``a``, ``b`` between nodes that tie all near copies together."""
    nodes = named.where("bands is not null and n > 0").select("node", F.explode("bands").alias("bucket"))
    buckets = nodes.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("_max")).where("hub <> _max")
    buckets = materialize(buckets.drop("_max"))
    members = materialize(nodes.join(buckets, "bucket").distinct())

    candidates = members.select("node").distinct()
    leaders = named.where("bands is not null and n > 0").select("first", "node", "c1").join(candidates, "node")
    copies = materialize(leaders.groupBy("node", "first", "c1").agg(F.count(F.lit(1)).alias("rows")))
    # One strategy at every size: the ids grow with the documents.
    texts = docs.join(copies.hint("merge"), docs["doc_id"] == copies["first"]).select("node", "c1", "text")
    sets = materialize(shingle_sets(texts))
    repeated = copies.where("rows > 1").select("node")
    if not repeated.isEmpty():  # rows that are there several times give one set
        once = sets.join(repeated, "node", "left_semi").dropDuplicates(["node"])
        sets = materialize(sets.join(repeated, "node", "left_anti").unionByName(once))
    stars = members.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    links = materialize(verify(stars, sets, threshold))
    first = components(links)

    labelled = members.join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = labelled.join(sets.select("node", "n"), "node")
    # Buckets of several classes; of buckets with equal members, one.
    mixed = labelled.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"), F.min("component").alias("low"), F.max("component").alias("high"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark"), F.min("node").alias("least"),
    ).where("low <> high and size > 2")
    mixed = mixed.groupBy("size", "total", "mark", "least").agg(F.min("bucket").alias("bucket"))
    mixed = mixed.select("bucket", "size", "total")
    more = search_blocks(labelled.join(mixed, "bucket"), sets, threshold)
    return links.union(more)


def leading_nodes(classes: DataFrame, named: DataFrame) -> DataFrame:
    """``classes`` with ``lead``: ``first`` and ``node`` of the class's smallest doc_id."""
    firsts = named.where("first <> node").select("node", "first").distinct()  # hashes; few
    of = classes.join(firsts, "node", "left").withColumn("first", F.coalesce("first", "node"))
    lead = of.groupBy("component").agg(F.min(F.struct("first", "node")).alias("lead"))
    return of.join(lead, "component").select("node", "lead")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``class_id`` (smallest doc_id of its class), ``kept``."""
    docs = docs.select("doc_id", "text")
    named = named_texts(materialize(signatures(docs, bands, rows)))
    links = node_links(docs, named, threshold)
    # All texts of a document are in one class.
    several = named.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("_max"))
    several = several.where("a <> _max").select("doc_id", "a")
    same = named.join(several, "doc_id").where("a <> node").select("a", F.col("node").alias("b")).distinct()
    classes = leading_nodes(components(links.union(same)), named)
    result = named.join(classes, "node", "left")
    label = F.when(F.col("doc_id").isNotNull(), F.coalesce("lead.first", "first"))
    result = result.select("doc_id", label.alias("class_id"))
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """The rows of ``docs`` without near copies: of each class of texts the one with the smallest doc_id.

    Rows are told apart by their text, so different texts of one doc_id stay. Of rows with
    one doc_id and the same words the smallest by all columns stays. Texts without
    words and rows without doc_id are no copies; of the former, equal rows stay once.
    """
    narrow = docs.select("doc_id", "text")
    named = named_texts(materialize(signatures(narrow, bands, rows)))
    classes = leading_nodes(components(node_links(narrow, named, threshold)), named)
    judged = named.where("doc_id is not null").join(classes, "node", "left")
    leads = (F.col("doc_id") == F.col("first")) & (F.coalesce("lead.node", "node") == F.col("node"))
    judged = materialize(judged.select("doc_id", "c1", "c2", "n", (leads | (F.col("n") == 0)).alias("kept")))
    # Most ids have one row, and the id decides.
    per_id = judged.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.bool_or("kept").alias("kept"))
    apart = materialize(per_id.where("rows > 1 or not kept"))
    plain = docs.where("doc_id is not null").join(apart.select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    out = plain.unionByName(docs.where("doc_id is null"))
    several = apart.where("rows > 1 and kept").select("doc_id")
    if several.isEmpty():
        return out
    wanted = judged.where("kept").join(several, "doc_id", "left_semi")
    wanted = wanted.select("doc_id", F.col("c1").alias("_c1"), F.col("c2").alias("_c2")).distinct()
    columns = docs.columns
    rest = salted_join(docs, several, ["doc_id"], "left_semi", counted=named.select("doc_id")).select(columns)
    hashed = contents(rest).join(wanted, ["doc_id", "_c1", "_c2"])
    own = [F.col(c) for c in columns]
    key = ["doc_id", "_c1", "_c2", F.when(F.col("_n") == 0, F.coalesce("text", F.lit("")))]
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*own))
    return out.unionByName(hashed.withColumn("_place", place).where("_place = 1").select(columns))


def contents(docs: DataFrame) -> DataFrame:
    """``docs`` with the content hashes ``_c1`` and ``_c2`` and the number ``_n`` of words of the text."""
    names = [c for c in docs.columns if c not in ("_c1", "_c2", "_n")]
    schema = docs.select(names).schema.add("_c1", "long").add("_c2", "long").add("_n", "long")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.drop_words()
        for batch in batches:
            for part in tk.slices(batch, "text"):
                hashes, owner, _ = tk.word_hashes(*tk.text_bytes(part.column("text")))
                one, two = content_hash(hashes, owner, part.num_rows)
                count = np.bincount(owner, minlength=part.num_rows)
                columns = [*part.columns, pa.array(one), pa.array(two), pa.array(count)]
                yield pa.RecordBatch.from_arrays(columns, [*names, "_c1", "_c2", "_n"])

    return docs.select(names).mapInArrow(describe, schema)
