"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms are words and their prefixes of 4 and 6 bytes; all terms of the examples make the
vocabulary, none is left out. A term weighs (1 + ln(occurrences)) * idf * relevance.
Document frequencies count all documents. Relevance is ``FLOOR`` for a term that says
nothing about the label, and more by how far its log-likelihood ratio over the labelled
documents exceeds what chance gives the largest of so many terms; without it the
cosine of whole texts is ruled by topic words and finds a fifth of the toxic texts.

Examples stand in an inverted index whose postings are cut into blocks of examples,
with the largest weight of each term in each block. A query adds up these block
maxima, and only blocks whose bound reaches the kth similarity known so far are
visited, so the neighbours are exact. Votes are weighted by similarity, and
by how many labelled rows an example of its class stands for; that makes the score a
share of labelled rows, and the neighbours are its evidence.

Two passes read the texts, without shuffling or storing them: one counts terms in each
task, one scores. Bounds of the fit: ``examples`` labelled documents of each class (by
a hash of the id, of at most ``EXAMPLE_CHARS`` characters) as neighbours, and about
``evidence_rows`` labelled ids for relevance. The index, that is broadcast, has the
size of the examples. Scoring covers all rows and whole texts.

Defined results: a text without any known term (also null or empty) has no neighbour
and gets the share of label 1 among the labelled rows; without usable labels every
score is 0; contradictory labels of one document count as separate examples; rows of
one doc_id count each as documents, and are one example with the smallest text;
similarity ties go to the smaller doc_id; rows keep their number; other columns pass
through, and added columns replace columns of the same name.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartlake.llm import textkernels as tk
from chartlake.llm.language import labelled_sample
from chartlake.session import materialize

PREFIXES = (4, 6)
EXAMPLES = 700
#: Longest text of an example.
EXAMPLE_CHARS = 100_000
#: Labelled ids that relevance is counted on (by a hash of the id, if there are more).
EVIDENCE_ROWS = 1_000_000
NEIGHBOURS = 9
#: Relevance of a term without evidence.
FLOOR = 0.02
#: Examples in one block of the index.
BLOCK = 128
#: Votes fall with this power of the similarity.
SHARPNESS = 4
#: Terms whose weights stand in a matrix rather than in postings.
COMMON = 1024
#: Texts scored together.
AT_ONCE = 64
#: Vote of the whole labelled set that is mixed into every score.
PRIOR_VOTES = 0.2


def text_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and word prefixes, and their text index."""
    words, owner, start = tk.word_hashes(data, offsets)
    found, of = [words], [owner]
    if len(words):
        table = tk.word_bytes()
        limit = offsets[owner + 1]
        prefix, live, at = np.zeros(len(words), np.uint64), np.ones(len(words), bool), start
        for k in range(max(PREFIXES) + 1):
            place = np.minimum(at + k, len(data) - 1)
            live = live & (at + k < limit) & table[data[place]]
            if k in PREFIXES:  # longer words only: a prefix isn't the word
                found.append(tk.mix(prefix[live] + np.uint64(k)))
                of.append(owner[live])
            prefix = prefix * np.uint64(tk.ODD) + data[place]
    return np.concatenate(found), np.concatenate(of)


class Vocabulary:
    """Term hashes in order, with a bit table that turns most other hashes away."""

    BITS = 22

    def __init__(self, terms: np.ndarray):
        self.terms = np.sort(terms)
        self.bits = np.zeros(1 << self.BITS, bool)
        self.bits[self._place(self.terms)] = True

    def _place(self, terms: np.ndarray) -> np.ndarray:
        return (terms >> np.uint64(64 - self.BITS)).astype(np.int64)

    def count(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text index, term index and occurrences of the known terms, in order."""
        terms, owner = text_terms(data, offsets)
        maybe = self.bits[self._place(terms)]
        terms, owner = terms[maybe], owner[maybe]
        at = np.searchsorted(self.terms, terms)
        hit = at < len(self.terms)
        hit[hit] = self.terms[at[hit]] == terms[hit]
        pair, times = np.unique(owner[hit] * len(self.terms) + at[hit], return_counts=True)
        return pair // max(len(self.terms), 1), pair % max(len(self.terms), 1), times


def relevance(toxic: np.ndarray, clean: np.ndarray, p: int, n: int) -> np.ndarray:
    """Factor of each term from the documents of each label it is in, of ``p`` and ``n`` in all."""
    total, terms = p + n, len(toxic)
    if not p or not n or not terms:
        return np.full(terms, FLOOR)
    share = (toxic + clean) / total

    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-300) / np.maximum(expected, 1e-300)), 0.0)

    ratio = 2 * (
        part(toxic, share * p) + part(clean, share * n) + part(p - toxic, (1 - share) * p) + part(n - clean, (1 - share) * n)
    )
    # The largest of so many ratios is near 2 ln(terms) by chance alone.
    return FLOOR + np.sqrt(np.maximum(ratio - 2 * np.log(terms), 0.0) / total)


@dataclass(frozen=True)
class Index:
    """Block-max inverted index of unit example vectors.

    The ``COMMON`` most frequent terms stand in a matrix, whose products with a batch of
    queries give every example a first part of its similarity. The other terms have
    postings: a cell is a term in a block, ``pointer`` gives a term's cells, ``start`` a
    cell's postings and ``bound`` the largest weight among them.
    """

    ids: np.ndarray
    labels: np.ndarray
    votes: np.ndarray
    row: np.ndarray  # of the matrix, by term; -1 for terms with postings
    matrix: np.ndarray
    pointer: np.ndarray
    block: np.ndarray
    bound: np.ndarray
    start: np.ndarray
    example: np.ndarray  # postings
    weight: np.ndarray

    @staticmethod
    def build(ids, labels, votes, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, common: int = COMMON) -> Index:
        # Examples with the same leading term share blocks, which makes the bounds tight.
        lead = np.array([t[w.argmax()] for t, w in vectors], np.int64)
        order = np.lexsort((ids, lead))
        vectors = [vectors[i] for i in order]
        blocks = max(-(-len(vectors) // BLOCK), 1)
        term = np.concatenate([t for t, _ in vectors]) if vectors else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in vectors]) if vectors else np.zeros(0)
        example = np.repeat(np.arange(len(vectors), dtype=np.int32), [len(t) for t, _ in vectors])
        by = np.lexsort((example, term))
        term, weight, example = term[by], weight[by], example[by]
        frequent = np.argsort(-np.bincount(term, minlength=terms), kind="stable")[:common]
        row = np.full(terms, -1, np.int32)
        row[frequent] = np.arange(len(frequent))
        matrix = np.zeros((len(frequent), blocks * BLOCK))
        dense = row[term] >= 0
        matrix[row[term[dense]], example[dense]] = weight[dense]
        term, weight, example = term[~dense], weight[~dense], example[~dense]
        cell = term * blocks + example // BLOCK
        known, start = np.unique(cell, return_index=True)
        bound = np.maximum.reduceat(weight, start) if len(start) else np.zeros(0)
        return Index(
            ids[order], labels[order], votes[order], row, matrix, np.searchsorted(known // blocks, np.arange(terms + 1)),
            (known % blocks).astype(np.int32), bound, np.append(start, len(example)), example, weight,
        )

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and similarities of the k examples most similar to each query (similarity above 0)."""
        n, places = len(self.ids), self.matrix.shape[1]
        first = np.zeros((len(queries), len(self.matrix)))
        for i, (terms, weights) in enumerate(queries):
            rows = self.row[terms]
            first[i, rows[rows >= 0]] = weights[rows >= 0]
        parts = first @ self.matrix
        tops = parts.reshape(len(queries), -1, BLOCK).max(2)
        result = []
        for (terms, weights), score, top in zip(queries, parts, tops):
            rare = self.row[terms] < 0
            cells, factor = _runs(self.pointer[terms[rare]], self.pointer[terms[rare] + 1], weights[rare])
            blocks = self.block[cells]
            bounds = top + np.bincount(blocks, weights=factor * self.bound[cells], minlength=len(top))
            # No similarity is below its first part, so neither is the kth: a block whose
            # bound is below that holds no neighbour.
            least = np.partition(score, places - k)[places - k] if n > k else 0.0
            live = (bounds >= least - 1e-9)[blocks]
            entry, factor = _runs(self.start[cells[live]], self.start[cells[live] + 1], factor[live])
            rest = np.bincount(self.example[entry], weights=factor * self.weight[entry], minlength=places)
            score = np.round(score + rest, 12)
            cut = np.partition(score, places - k)[places - k] if n > k else 0.0
            found = np.flatnonzero((score >= cut) & (score > 0))
            best = found[np.lexsort((self.ids[found], -score[found]))[:k]]
            result.append((best, score[best]))
        return result


def _runs(first: np.ndarray, end: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, one after the other, each with its range's weight."""
    size = end - first
    before = np.cumsum(size) - size
    return np.arange(size.sum()) + np.repeat(first - before, size), np.repeat(weights, size)


@dataclass(frozen=True)
class Model:
    vocabulary: np.ndarray
    factor: np.ndarray  # idf times relevance
    index: Index
    prior: float

    def score(self, texts: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[float, list[int]]]:
        """For each text (its terms and their times) the share of label 1 around it, and the examples that say so."""
        result: list[tuple[float, list[int]]] = [(self.prior, [])] * len(texts)
        filled = [i for i, (terms, _) in enumerate(texts) if len(terms)] if len(self.index.ids) else []
        for at in range(0, len(filled), AT_ONCE):
            some = filled[at : at + AT_ONCE]
            found = self.index.nearest([weigh(*texts[i], self.factor) for i in some], k)
            for i, (places, near) in zip(some, found):
                votes = near**SHARPNESS * self.index.votes[places]
                total = votes @ self.index.labels[places] + PRIOR_VOTES * self.prior
                result[i] = float(total / (votes.sum() + PRIOR_VOTES)), self.index.ids[places].tolist()
        return result


def weigh(terms: np.ndarray, times: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms and weights of a unit vector."""
    w = (1 + np.log(times)) * factor[terms]
    return terms, w / np.sqrt((w * w).sum())


def usable_labels(labels: DataFrame) -> DataFrame:
    usable = labels.where("label is not null and doc_id is not null").select("doc_id", F.col("label").cast("int").alias("label"))
    return usable.where("label in (0, 1)").distinct()


def label_sample(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """``doc_id``, ``text`` and ``label`` of a bounded sample of the usable ``labels``.

    The sample is drawn from the label table alone; its ids (two classes of at most
    ``examples``) are broadcast to the documents.
    """
    chosen = labelled_sample(labels.withColumn("order", F.xxhash64("doc_id")), "label", "order", examples)
    short = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= EXAMPLE_CHARS)
    found = short.join(F.broadcast(materialize(chosen.select("doc_id", "label"))), "doc_id")
    # Rows of one id are one example: its smallest text.
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def term_lists(sample: DataFrame) -> DataFrame:
    """``doc_id``, ``label`` and, as bytes, the distinct ``terms`` (hashes) and their ``times``."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text"):
                hashes, owner = text_terms(*tk.text_bytes(part.column("text")))
                terms, times = [], []
                for i in range(part.num_rows):
                    t, n = np.unique(hashes[owner == i], return_counts=True)
                    terms.append(t.tobytes()), times.append(n.astype("<i4").tobytes())
                lists = [pa.array(terms, pa.binary()), pa.array(times, pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("label"), *lists], ["doc_id", "label", "terms", "times"]
                )

    return sample.select("doc_id", "label", "text").mapInArrow(describe, "doc_id long, label int, terms binary, times binary")


def term_counts(docs: DataFrame, labels: DataFrame, vocabulary: np.ndarray, evidence_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of each term of the vocabulary: all, labelled 1 and labelled 0; and of all terms.

    A task counts into one array and gives its terms once; ``labels`` beyond
    ``evidence_rows`` are thinned by a hash, so that they can be broadcast.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    ids = materialize(labels.groupBy("doc_id").agg(F.max("label").alias("p"), (1 - F.min("label")).alias("n")))
    known = materialize(ids.where(place * F.lit(max(ids.count(), 1)) < evidence_rows))
    marked = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id", "left").select("p", "n", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(shared.value)
        found = np.zeros((3, len(words.terms) + 1), np.int64)  # the last place counts texts
        for batch in batches:
            for part in tk.slices(batch, "text"):
                row, term, _ = words.count(*tk.text_bytes(part.column("text")))
                row, term = np.append(row, np.arange(part.num_rows)), np.append(term, np.full(part.num_rows, len(words.terms)))
                found[0] += np.bincount(term, minlength=found.shape[1])
                for at, name in ((1, "p"), (2, "n")):
                    flag = part.column(name).fill_null(0).to_numpy(zero_copy_only=False) > 0
                    found[at] += np.bincount(term[flag[row]], minlength=found.shape[1])
        some = np.flatnonzero(found[0])
        for at in range(0, len(some), 1 << 16):
            part = some[at : at + (1 << 16)]
            columns = [pa.array(part, pa.int32()), *[pa.array(found[i, part]) for i in range(3)]]
            yield pa.RecordBatch.from_arrays(columns, ["term", "d", "p", "n"])

    parts = marked.mapInArrow(count, "term int, d long, p long, n long")
    sums = parts.groupBy("term").agg(*[F.sum(c).alias(c) for c in "dpn"]).toArrow()  # one row a term of the examples
    totals = np.zeros((3, len(vocabulary) + 1), np.int64)
    for i, c in enumerate("dpn"):
        totals[i, sums.column("term").to_numpy()] = sums.column(c).to_numpy()
    return totals[:, :-1], totals[:, -1]


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, evidence_rows: int = EVIDENCE_ROWS) -> Model:
    """Model from the labelled rows among ``docs`` and the term frequencies of all of them."""
    usable = materialize(usable_labels(labels))
    weight = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    rows = term_lists(materialize(label_sample(docs, usable, examples))).collect()
    terms = [np.frombuffer(r.terms, np.uint64) for r in rows]
    vocabulary = np.unique(np.concatenate(terms)) if terms else np.zeros(0, np.uint64)
    count = {label: sum(r.label == label for r in rows) for label in (0, 1)}
    votes = np.array([weight[r.label] / count[r.label] for r in rows])
    seen = [label for label in (0, 1) if count[label]]
    prior = weight[1] / sum(weight[label] for label in seen) if 1 in seen else 0.0
    factor = np.zeros(0)
    if len(vocabulary):
        (frequency, toxic, clean), (texts, p, n) = term_counts(docs, usable, vocabulary, evidence_rows)
        factor = (np.log((1 + texts) / (1 + frequency)) + 1) * relevance(toxic, clean, int(p), int(n))
    filled = [i for i, t in enumerate(terms) if len(t)]
    vectors = [weigh(np.searchsorted(vocabulary, terms[i]), np.frombuffer(rows[i].times, "<i4"), factor) for i in filled]
    index = Index.build(
        np.array([rows[i].doc_id for i in filled], np.int64), np.array([rows[i].label for i in filled], float),
        votes[filled] if filled else np.zeros(0), vectors, len(vocabulary),
    )
    return Model(vocabulary, factor, index, prior)


def score_documents(
    docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, neighbours: int = NEIGHBOURS, evidence_rows: int = EVIDENCE_ROWS
) -> DataFrame:
    """``docs`` without ``text``, plus ``score`` and ``evidence`` (ids of the nearest examples).

    ``labels`` has ``doc_id`` and ``label`` (0 or 1) of the rows to learn from.
    """
    spark = docs.sparkSession
    docs = docs.drop("score", "evidence")
    tk.arrow_batches(spark)
    shared = spark.sparkContext.broadcast(astuple(fit(docs, labels, examples, evidence_rows)))  # plain values
    kept = docs.drop("text")
    names, columns = kept.columns, [*kept.columns, "score", "evidence"]
    schema = T.StructType(
        [*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(T.LongType()))]
    )

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, factor, index, prior = shared.value
        model, known = Model(terms, factor, Index(*index), prior), Vocabulary(terms)
        for batch in batches:
            for part in tk.slices(batch, "text"):
                row, term, times = known.count(*tk.text_bytes(part.column("text")))
                edge = np.searchsorted(row, np.arange(part.num_rows + 1))
                found = model.score([(term[a:b], times[a:b]) for a, b in zip(edge, edge[1:])], neighbours)
                scores, evidence = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [*part.select(names).columns, pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(pa.int64()))], columns
                )

    # The text is the last column, so that dropping it leaves the others in place.
    return docs.select(*kept.columns, "text").mapInArrow(vote, schema)
