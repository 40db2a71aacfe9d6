"""Language identification with a string kernel.

The kernel of two texts is the normalized number of character n-grams (runs of
UTF-8 bytes of the lower-cased text, lengths 2 to 4, counted once) they share.
Labelled texts are described by their kernels with landmark texts (Nystroem), one
ridge regression per language is fitted on them, and new texts are scored by
products of two matrices: presence x landmarks, then kernels x coefficients.

The n-grams of the landmarks are the columns of the presence matrix; they are found
by a multiplicative hash of their bytes into 2**18 places.

Bounds of the fit: the ``labels`` most frequent languages and, for each, ``landmarks``
and ``examples`` (chosen by a hash of the row). The driver receives the landmark texts and one short vector per
example. Scoring is one pass over whole texts without a shuffle.

Defined results: ``und`` with score 0 for a text that is null or has no letter, and
for all texts if nothing can be learned; scores are a softmax over the languages;
rows keep their number; equal texts get equal results; if only one language is known
it gets every text with a letter, with score 1; other columns pass through, and added
columns replace columns of the same name.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartlake.llm import textkernels as tk
from chartlake.session import materialize

LENGTHS = (2, 3, 4)
PLACES = 18
UNKNOWN = "und"
#: Rows of the presence matrix made at once.
ROWS = 64
SHARPNESS = 4.0
#: Languages learned: those with the most labelled rows, ties by name.
LABELS = 256
#: Preferred length of landmark texts, which the driver receives.
LANDMARK_CHARS = (200, 50_000)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    column: np.ndarray  # place of an n-gram -> column of the presence matrix
    landmarks: np.ndarray  # columns x landmarks, 0/1, scaled to unit length
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray


def _places(data: np.ndarray, length: int) -> np.ndarray:
    """Hash places of all runs of ``length`` bytes."""
    if len(data) < length:
        return np.zeros(0, np.int64)
    n = len(data) - length + 1
    value = np.full(n, length, np.uint32)
    for k in range(length):
        value = value * np.uint32(0x01000193) + data[k : k + n]
    return ((value * np.uint32(0x9E3779B1)) >> np.uint32(32 - PLACES)).astype(np.int64)


def presence(data: np.ndarray, offsets: np.ndarray, column: np.ndarray, columns: int) -> np.ndarray:
    """0/1 matrix of texts x columns; the last column collects what has none."""
    out = np.zeros((len(offsets) - 1, columns + 1), np.float32)
    flat, row = out.reshape(-1), np.repeat(np.arange(len(offsets) - 1) * (columns + 1), np.diff(offsets))
    for length in LENGTHS:
        at = column[_places(data, length)]
        for k in range(1, length):  # runs that go beyond their text
            tail = offsets[1:] - k
            at[tail[(tail >= 0) & (tail < len(at))]] = columns
        flat[row[: len(at)] + at] = 1
    return out


def kernels(data: np.ndarray, offsets: np.ndarray, column: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Kernel values of texts x landmarks."""
    columns = len(landmarks)
    out = np.zeros((len(offsets) - 1, landmarks.shape[1]), np.float32)
    for low in range(0, len(out), ROWS):
        edges = offsets[low : low + ROWS + 1]
        matrix = np.zeros((len(edges) - 1, columns + 1), np.float32)
        for at in range(edges[0], max(edges[-1], edges[0] + 1), tk.BLOCK):  # a long text goes block by block
            end = min(edges[-1], at + tk.BLOCK + max(LENGTHS) - 1)
            np.maximum(matrix, presence(data[at:end], np.clip(edges, at, end) - at, column, columns), out=matrix)
        matrix = matrix[:, :columns]
        norm = np.sqrt(np.maximum(matrix.sum(1), 1.0))
        out[low : low + ROWS] = (matrix @ landmarks) / norm[:, None]
    return out


def labelled_sample(docs: DataFrame, label: str, order: str, bound: int) -> DataFrame:
    """At most ``bound`` rows of each label, with ``_rank`` from 1 by a hash column.

    Only labels and hashes are counted, thinned and ranked: the ranking sees about twice
    the bound of a label, however many rows have it, and rows are then picked by the
    chosen hashes, a table with that bound. Other columns are not shuffled, and of rows
    with one label and hash (repeated rows) one is kept.
    """
    narrow = docs.select(label, order)
    counts = materialize(narrow.groupBy(label).agg(F.count(F.lit(1)).alias("_rows")))
    place = F.pmod(F.col(order), F.lit(1 << 30)) / float(1 << 30)
    thinned = narrow.join(counts, label).where(place * F.col("_rows") < 2.0 * bound + 20)
    thinned = thinned.select(label, order).distinct()
    ranked = thinned.withColumn("_rank", F.row_number().over(Window.partitionBy(label).orderBy(order)))
    chosen = materialize(ranked.where(F.col("_rank") <= bound))
    return docs.join(F.broadcast(chosen), [label, order]).dropDuplicates([label, order])


def fit(
    labelled: DataFrame, text: str = "text", label: str = "lang", landmarks: int = 16, examples: int = 400,
    ridge: float = 1e-2, labels: int = LABELS,
) -> Model | None:
    """Fit on the rows of ``labelled`` with a label; None if there are none."""
    spark = labelled.sparkSession
    tk.arrow_batches(spark)
    order = F.xxhash64(*[F.col(c) for c in labelled.columns])
    rows = labelled.select(F.col(text).alias("text"), F.col(label).alias("label"), order.alias("order"))
    rows = rows.where(F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("_rows"))
    frequent = materialize(counts.orderBy(F.desc("_rows"), "label").limit(labels).select("label"))
    sample = materialize(labelled_sample(rows.join(F.broadcast(frequent), "label"), "label", "order", examples))
    # Landmarks: the first of each label, texts of some length before very short or long ones.
    odd = (~F.length("text").between(*LANDMARK_CHARS)).cast("int")
    rank = F.row_number().over(Window.partitionBy("label").orderBy(odd, "_rank"))
    chosen = sample.withColumn("_mark", rank).where(F.col("_mark") <= landmarks)
    texts = [r[0] for r in chosen.orderBy("label", "_mark").select("text").collect()]
    if not texts:
        return None
    data, offsets = tk.text_bytes(pa.array(texts))
    seen = np.zeros(1 << PLACES, bool)
    for length in LENGTHS:
        for low, high in zip(offsets[:-1], offsets[1:]):
            seen[_places(data[low:high], length)] = True
    columns = int(seen.sum())
    column = np.full(1 << PLACES, columns, np.int32)
    column[seen] = np.arange(columns)
    marks = np.stack([presence(data[a:b], np.array([0, b - a]), column, columns)[0, :columns] for a, b in zip(offsets, offsets[1:])])
    marks = (marks / np.sqrt(np.maximum(marks.sum(1, keepdims=True), 1))).T.astype(np.float32)
    shared = spark.sparkContext.broadcast((column, marks))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.drop_words()
        column, marks = shared.value
        for batch in batches:
            for part in tk.slices(batch, "text"):
                k = kernels(*tk.text_bytes(part.column("text")), column, marks)
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"), pa.array([x.tobytes() for x in k], pa.binary())], ["label", "kernel"]
                )

    schema = T.StructType([rows.schema["label"], T.StructField("kernel", T.BinaryType())])
    described = sample.select("text", "label").mapInArrow(describe, schema).collect()
    languages = sorted({r.label for r in described})
    K = np.stack([np.frombuffer(r.kernel, np.float32) for r in described]).astype(np.float64)
    Y = np.array([[1.0 if r.label == name else -1.0 for name in languages] for r in described])
    # Nystroem features K W^(-1/2); the ridge solution is folded back onto the kernels.
    values, vectors = np.linalg.eigh(marks.T.astype(np.float64) @ marks)
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    feature = K @ root
    center, mean = feature.mean(0), Y.mean(0)
    centered = feature - center
    solved = np.linalg.solve(
        centered.T @ centered + ridge * len(K) * np.eye(centered.shape[1]) / 10, centered.T @ (Y - mean)
    )
    weights = root @ solved
    return Model(languages, column, marks, weights.astype(np.float32), (mean - center @ solved).astype(np.float32))


def classify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` plus ``lang_pred`` and ``score``."""
    spark = docs.sparkSession
    tk.arrow_batches(spark)
    shared = spark.sparkContext.broadcast(astuple(model) if model else None)  # plain values
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    kept = docs.select(names)
    schema = T.StructType(
        [*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.drop_words()
        model = Model(*shared.value) if shared.value else None
        for batch in batches:
            for part in tk.slices(batch, text):
                column = part.column(text)
                letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                best, share = np.full(part.num_rows, UNKNOWN, object), np.zeros(part.num_rows)
                if model is not None:
                    k = kernels(*tk.text_bytes(column), model.column, model.landmarks)
                    power = SHARPNESS * (k @ model.weights + model.bias).astype(np.float64)
                    power = np.exp(power - power.max(1, keepdims=True))
                    power /= power.sum(1, keepdims=True)
                    best = np.where(letters, np.array(model.languages, object)[power.argmax(1)], UNKNOWN)
                    share = np.where(letters, power.max(1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(best, pa.string()), pa.array(share)], [*part.schema.names, "lang_pred", "score"]
                )

    return kept.mapInArrow(score, schema)


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))
