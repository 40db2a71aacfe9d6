"""Tokenize documents and pack them into sequences by best-two-fit.

Documents are encoded whole; only ones longer than a sequence are cut, into full
pieces and a rest. Pieces are dealt to groups of bounded size, and each group is
packed on its own: every bin starts with the longest piece left and is filled with
the longest that fits; then its smallest piece is exchanged for two unpacked ones
whose sum fits the widened gap more tightly. A group leaves one poorly filled bin,
so thousands of pieces a group cost a negligible share of sequences.

Defined results: a null or empty text is the end token alone; repeated rows are
packed each; an empty table gives no rows; other columns of the pieces pass through, and the added
columns replace columns of the same name; where sequences are kept apart by a column, null is a
value of its own.
"""
from __future__ import annotations

import os
import re
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartlake.llm import textkernels as tk
from chartlake.session import materialize

CAPACITY = 2048
END_TOKEN = 0
#: Pieces packed together. The group's task holds its pieces' lengths and columns.
GROUP_PIECES = 16_384
#: Bytes of encoded words that a Python process keeps; beyond that it starts over.
CACHE_BYTES = 128 << 20
#: Bytes that keeping a word takes besides its letters and ids.
WORD_BYTES = 170


#: A stop or comma after an ASCII or Latin-1 letter or digit, at the end of a word.
STOP = re.compile(rb"(?:(?<=[a-z0-9])|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]))([.,])(?= )")


def _byte_kinds() -> bytes:
    kinds = bytearray(b"!" * 128 + b"c" * 64 + b"L" * 64)
    for c in b"abcdefghijklmnopqrstuvwxyz0123456789":
        kinds[c] = ord("a")
    kinds[ord(" ")], kinds[ord(".")], kinds[ord(",")] = ord(" "), ord("."), ord(".")
    kinds[0xC3], kinds[0x97], kinds[0xB7] = ord("C"), ord("y"), ord("y")  # the two signs among Latin-1 letters
    return bytes(kinds)


KINDS = _byte_kinds()
#: What may stand before a stop so that cutting there could change ids.
ODD_STOPS = (b"!.", b"..", b"Lc.", b"cc.", b"y.", b" .")


def split_words(text: str) -> list[bytes]:
    """Cut a text where this tokenizer's ids don't depend on it: at spaces, line feeds and
    before a stop or comma that ends a word. ASCII letters become small, as the tokenizer
    makes them, unless the text has marks that combine with them or a special token."""
    data = text.encode()
    if not (b"\xcc" in data or b"\xcd" in data or b"<|" in data):
        data = data.lower()
    data = data.replace(b"\n", b" ") + b" "
    kinds = data.translate(KINDS)
    if any(odd in kinds for odd in ODD_STOPS):
        data = STOP.sub(rb" \1", data)
    else:
        data = data.replace(b". ", b" . ").replace(b", ", b" , ")
    return data.split(b" ")


def encoder(definition: str, end_token: int = END_TOKEN) -> Callable[[list[str]], list[bytes]]:
    """Encode texts as little-endian 32-bit ids plus the end token.

    A text's ids are those of its words, and a word that comes again is looked up.
    The words known are kept for the next task of the same Python process, until one of
    another kind drops them. A task encodes in its own thread: more threads only add memory.
    """
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    state = sys.modules.setdefault(tk.WORDS_KEPT, types.ModuleType(tk.WORDS_KEPT)).__dict__
    if state.get("definition") != definition:
        state |= {"definition": definition, "tokenizer": Tokenizer.from_str(definition), "known": {b"": b""}, "bytes": 0}
    tokenizer, known = state["tokenizer"], state["known"]
    end = np.array([end_token], "<u4").tobytes()

    def encode(texts: list[str]) -> list[bytes]:
        if state["bytes"] > CACHE_BYTES:
            known.clear()
            known[b""], state["bytes"] = b"", 0
        words = [split_words(t) for t in texts]
        new = list(set().union(*words).difference(known))
        coded = tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
        ids = [np.array(e.ids, "<u4").tobytes() for e in coded]
        known.update(zip(new, ids))
        state["bytes"] += sum(map(len, new)) + sum(map(len, ids)) + WORD_BYTES * len(new)
        return [b"".join(map(known.__getitem__, ws)) + end for ws in words]

    return encode


def encode_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text",
    by: str | None = None,
) -> DataFrame:
    """Rows ``doc_id``, ``piece``, ``start``, ``length``, ``ids`` (little-endian 32-bit), and the column ``by``."""
    spark = docs.sparkSession
    tk.arrow_batches(spark)
    passed = [by] if by else []
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = spark.sparkContext.broadcast(file.read())
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[doc_id].dataType),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            *[docs.schema[c] for c in passed],
        ]
    )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(definition.value)
        for batch in batches:
            for part in tk.slices(batch, "text"):
                rows, number, start, length, ids = [], [], [], [], []
                coded = encode([t or "" for t in part.column("text").to_pylist()])
                for row, code in enumerate(coded):
                    for k, at in enumerate(range(0, len(code), 4 * capacity)):
                        cut = code[at : at + 4 * capacity]
                        rows.append(row), number.append(k), ids.append(cut)
                        start.append(at // 4), length.append(len(cut) // 4)
                of = pa.array(rows, pa.int64())
                columns = [
                    part.column("doc_id").take(of), pa.array(number, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()),
                    *[part.column(c).take(of) for c in passed],
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids", *passed])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *passed).mapInArrow(pieces, schema)


def best_two_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (1..capacity).

    The lengths still unpacked are the set bits of an integer, so "longest that fits"
    and "two that sum to this" are single operations on bits.
    """
    held: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in range(len(lengths) - 1, -1, -1):
        held[lengths[i]].append(i)
    free = sum(1 << n for n in range(1, capacity + 1) if held[n])
    turned = sum(1 << (capacity - n) for n in range(1, capacity + 1) if held[n])
    bins, offsets, number = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0

    def take(n: int) -> int:
        nonlocal free, turned
        i = held[n].pop()
        if not held[n]:
            free ^= 1 << n
            turned ^= 1 << (capacity - n)
        return i

    def give_back(i: int) -> None:
        nonlocal free, turned
        n = lengths[i]
        if not held[n]:
            free |= 1 << n
            turned |= 1 << (capacity - n)
        held[n].append(i)

    def two(most: int, least: int) -> tuple[int, int] | None:
        for total in range(most, least, -1):
            both = free & (turned >> (capacity - total))
            while both:
                a = both.bit_length() - 1
                if a * 2 != total or len(held[a]) > 1:
                    return a, total - a
                both ^= 1 << a
        return None

    lengths = [int(n) for n in lengths]
    while free:
        inside = [take(free.bit_length() - 1)]
        gap = capacity - lengths[inside[0]]
        while gap and (fits := free & ((1 << (gap + 1)) - 1)):
            inside.append(take(fits.bit_length() - 1))
            gap -= lengths[inside[-1]]
        if gap and (pair := two(gap + lengths[inside[-1]], lengths[inside[-1]])):
            give_back(inside.pop())
            inside += [take(pair[0]), take(pair[1])]
        at = 0
        for i in inside:
            bins[i], offsets[i] = number, at
            at += lengths[i]
        number += 1
    return bins, offsets


def deal(pieces: DataFrame, group_pieces: int, by: str) -> DataFrame:
    """``pieces`` plus ``_group``; a group holds one value of ``by`` and about ``group_pieces`` rows at most."""
    pieces = pieces.drop("_of", "_groups", "_first", "_place")
    groups = F.ceil(F.count(F.lit(1)) / group_pieces)
    counts = pieces.groupBy(F.col(by).alias("_of")).agg(groups.alias("_groups"))
    earlier = Window.orderBy(F.col("_of").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("_groups").over(earlier), F.lit(0))
    numbered = materialize(counts.withColumn("_first", first))  # one row per value
    placed = pieces.withColumn("_place", F.xxhash64(F.monotonically_increasing_id()))
    joined = placed.join(numbered, F.col(by).eqNullSafe(F.col("_of")))
    dealt = joined.withColumn("_group", F.col("_first") + F.pmod("_place", "_groups"))
    return dealt.select(*pieces.columns, "_group")


def pack(
    pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, by: str | None = None
) -> DataFrame:
    """``pieces`` (with a ``length`` column) plus ``sequence_id`` and ``offset``.

    With ``by``, a sequence holds pieces of one value of that column only. ``pieces``
    should be a stored table: the deal of its rows to groups follows their
    place in it and must repeat when a task is run again.
    """
    pieces = pieces.drop("sequence_id", "offset", "_group")
    if by is None:
        groups = F.lit(max(1, -(-pieces.count() // group_pieces)))
        dealt = pieces.withColumn("_group", F.pmod(F.monotonically_increasing_id(), groups).cast("long"))
    else:
        dealt = deal(pieces, group_pieces, by)
    schema = T.StructType(
        [*dealt.drop("_group").schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        tk.drop_words()
        rows = group.drop(columns="_group")
        bins, offsets = best_two_fit(rows["length"].to_numpy(), capacity)
        return rows.assign(sequence_id=group["_group"].to_numpy() * (1 << 31) + bins, offset=offsets)

    return dealt.groupBy("_group").applyInPandas(packed, schema)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, by: str | None = None
) -> DataFrame:
    """Packed pieces of ``docs`` with ``ids_crc32`` in place of the ids, and the column ``by``, which keeps sequences apart."""
    pieces = encode_pieces(docs, tokenizer_path, capacity, by=by)
    return pack(materialize(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")), capacity, by=by)
