"""Brute-force forms and awkward inputs that several tests use."""
from __future__ import annotations

import itertools
import re
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


def words(text: str | None) -> list[str]:
    return re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (text or "").lower())


def shingle_set(text: str | None) -> set[tuple[str, ...]]:
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def clashing(df):
    """The frame with columns named like those operators add or use inside."""
    names = [
        "score", "lang_pred", "size", "label", "node", "bands", "bucket", "pii", "_spans", "target", "copies", "taken",
        "place", "position", "copy", "source_size", "schedule", "_key", "_slice", "terms", "times", "evidence", "a", "b",
        "sequence_id", "offset", "_group", "held_out", "rank", "v", "rep", "part", "seq",
    ]
    return df.select("*", *[F.lit("x").alias(n) for n in names if n not in df.columns])


def classes_by_brute_force(texts: dict[int, str | None]) -> dict[int, int]:
    sets = {i: shingle_set(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def check_packing(rows, texts: dict[int, str | None]) -> None:
    tokenizer = Tokenizer.from_file(WORDS)
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(texts)
    for i, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        pieces = sorted(by[i], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(-(-len(ids) // 2048)))
        for k, p in enumerate(pieces):
            part = np.array(ids[k * 2048 : (k + 1) * 2048], "<u4")
            assert (p.start, p.length, p.ids_crc32) == (k * 2048, len(part), zlib.crc32(part.tobytes()))
    check_sequences(rows)


def check_sequences(rows) -> None:
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(bins) <= 1.02 * (total / 2048) + 1
