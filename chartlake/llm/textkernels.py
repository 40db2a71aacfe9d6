"""Helpers for tasks that work on Arrow columns of text as byte arrays.

Texts are lower-cased, encoded as UTF-8 and hashed in bulk. A word is a run of
ASCII letters, digits and non-ASCII bytes. A null text counts as empty.
"""
from __future__ import annotations

import sys
from collections.abc import Iterator
from gc import collect as collect_garbage

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer text is a block of its own.
BLOCK = 1 << 20
ODD = 0x9E3779B97F4A7C15
#: Set for the tasks' sake by ``arrow_batches``: rows in one Arrow batch.
ROWS = 512
#: Module in which a Python worker keeps what packing tasks know of words.
WORDS_KEPT = "_packing_state"


def arrow_batches(spark) -> None:
    """Small Arrow batches, so that long texts don't add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))


def drop_words() -> None:
    """Drop the words that earlier packing tasks kept in this Python worker.

    Spark gives a worker to tasks of all operators; those that don't look words up call
    this first, so that their memory doesn't come on top of the words'.
    """
    if sys.modules.pop(WORDS_KEPT, None) is not None:
        collect_garbage()  # the last task's function may still refer to them


def word_bytes() -> np.ndarray:
    table = np.zeros(256, bool)
    table[128:] = True
    for first, last in ("az", "AZ", "09"):
        table[ord(first) : ord(last) + 1] = True
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (finalizer of the SplitMix64 generator)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def uniform(h: np.ndarray) -> np.ndarray:
    """Hash values as numbers in (0, 1)."""
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def text_bytes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and the offsets of its texts in them."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets) or offsets[-1] == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most ``limit`` bytes of text, or of one row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, done + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = table[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    before[edges] = False
    after[edges - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text index and start byte of every word, in order."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    table = word_bytes()
    start, end = _word_spans(data, offsets, table)
    hashes = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):  # blocks bound the tables of powers
        to = max(at + 1, int(np.searchsorted(end, start[at] + BLOCK, side="right")))
        low, high = start[at], end[to - 1]
        place = np.arange(high - low, dtype=np.int64)
        span = np.zeros(high - low, np.int64)
        span[start[at:to] - low] = 1
        place -= (start[at:to] - low)[np.cumsum(span) - 1]
        power = np.cumprod(np.full(int((end[at:to] - start[at:to]).max()), ODD, np.uint64))
        value = np.where(
            table[data[low:high]], (data[low:high].astype(np.uint64) + np.uint64(1)) * power[np.minimum(place, len(power) - 1)],
            np.uint64(0),
        )
        hashes[at:to] = np.add.reduceat(value, start[at:to] - low)
        at = to
    return mix(hashes), np.searchsorted(offsets, start, side="right") - 1, start


def shingles(words: np.ndarray, owner: np.ndarray, texts: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words and their text index, in order.

    A text with fewer words has one shingle of all its words; one without words has none.
    """
    if not len(words):
        return words, owner
    total = np.zeros(len(words), np.uint64)
    counts = np.bincount(owner, minlength=texts)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    left = (first + counts)[owner] - np.arange(len(words))
    factor = np.uint64(1)
    for k in range(min(size, len(words))):
        factor = np.uint64((int(factor) * ODD) & (2**64 - 1))
        total[: len(words) - k] += np.where(left[: len(words) - k] > k, words[k:] * factor, np.uint64(0))
    keep = (left >= size) | ((counts[owner] < size) & (left == counts[owner]))
    return mix(total[keep]), owner[keep]


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], joined: bool = True) -> Iterator[pa.Table]:
    """Runs of rows with equal (not null) keys in sorted batches, one table each.

    With ``joined`` false a run is given in parts, one for each batch it lies in.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            key = tuple(c[a] for c in columns)
            if held and (key != last or not joined):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)
