"""License notices: MinHash bands over overlapping windows, then exact containment.

Texts are sequences of shingles of five words. A template of n shingles belongs to the
scale s, the power of two from n on; windows of 2s shingles start every s shingles, so
a notice lies whole in one of them. A window that holds 0.8 of a template has at least
the Jaccard similarity J = need / (2s + n - need) with it (need: shingles that 0.8
asks for); bands of one MinHash each, 1e-5 = (1 - J)**bands, so a notice is missed
with probability 1e-5. Window minima of all scales come from pairwise minima of one
hash array. Windows that share a band with a template are candidates; a match is an
exact share of the template's shingles, in the window and its surroundings within the
document, of at least 0.8. Of a partial match, every number (version) of the template
must be there too, and no similar template may explain all of it with a larger share.

One pass over whole texts, no shuffle; templates are few and travel with the task.

Defined results: a null or empty text, or one of less than five words, has no match;
a template in several places of a document gives one row, its best place (ties: the
first); repeated rows give their matches each.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chartlake.llm import textkernels as tk

CONTAINMENT = 0.8
MISS = 1e-5

# The wording of public license notices.
# A long text is found by its heading, opening or notice; a short one by its clauses.
NOTICES: dict[str, str] = {
    "AGPL-3.0": "under the GNU Affero General Public License, version 3",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
    "option) any later version.",
    "AGPL-3.0-text": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "Apache-2.0-text": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, "
    "REPRODUCTION, AND DISTRIBUTION",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "Apache-2.0-disclaimer": "Unless required by applicable law or agreed to in writing, software distributed under the License is "
    "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met",
    "BSD-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer.",
    "BSD-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-disclaimer": "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "BSD-liability": "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT "
    "NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "contributors may be used to endorse or promote products derived from this software without specific prior "
    "written permission.",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to "
    "this software to the public domain worldwide. This software is distributed without any warranty.",
    "CC0-1.0-text": "The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights "
    "(defined below) upon the creator and subsequent owner(s) (each and all, an \"owner\") of an original work of authorship "
    "and/or a database (each, a \"Work\").",
    "CC-BY-3.0": "licensed under a Creative Commons Attribution 3.0",
    "CC-BY-NC-3.0": "Creative Commons Attribution-NonCommercial 3.0",
    "CC-BY-NC-SA-3.0": "Creative Commons Attribution-NonCommercial-ShareAlike 3.0",
    "CC-BY-ND-3.0": "Creative Commons Attribution-NoDerivs 3.0",
    "CC-BY-SA-3.0": "Creative Commons Attribution-ShareAlike 3.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "EPL-1.0": "made available under the terms of the Eclipse Public License v1.0",
    "EPL-2.0": "made available under the terms of the Eclipse Public License 2.0",
    "EPL-text": "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\"). ANY USE, "
    "REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.",
    "GPL-2.0": "under the GNU General Public License, version 2",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
    "General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
    "option) any later version.",
    "GPL-2.0-text": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0-text": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
    "option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1": "under the GNU Lesser General Public License, version 2.1",
    "LGPL-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
    "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
    "option) any later version.",
    "LGPL-2.1-text": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "LGPL-3.0": "under the GNU Lesser General Public License, version 3",
    "LGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
    "option) any later version.",
    "LGPL-3.0-text": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "MIT": "Released under the MIT License",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "MIT-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
    "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
    "not distributed with this file, You can obtain one at",
    "MPL-2.0-text": "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\"",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def scale_of(shingles: int) -> int:
    return 1 << max(0, (shingles - 1).bit_length())


def needed(shingles: int, containment: float = CONTAINMENT) -> int:
    return math.ceil(containment * shingles - 1e-9)


def bands_for(shingles: int, containment: float = CONTAINMENT, miss: float = MISS) -> int:
    """Bands that find a window holding the template, but for the given probability."""
    need = needed(shingles, containment)
    similarity = need / (2 * scale_of(shingles) + shingles - need)
    return math.ceil(math.log(miss) / math.log(1 - similarity)) if similarity < 1 else 1


def factors(bands: int) -> np.ndarray:
    """Odd multipliers: the hash functions of the bands."""
    seeds = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(tk.ODD)
    return (tk.mix(seeds) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


class Templates:
    """Distinct shingles of the templates and their band values, by scale."""

    def __init__(self, texts: Mapping[str, str], containment: float = CONTAINMENT, miss: float = MISS):
        self.names = sorted(texts)
        self.containment = containment
        self.sets: list[np.ndarray] = []
        for name in self.names:
            data, offsets = tk.text_bytes(pa.array([texts[name]]))
            hashes, owner, _ = tk.word_hashes(data, offsets)
            if len(hashes) < 5:
                raise ValueError(f"template {name} has less than five words")
            self.sets.append(np.unique(tk.shingles(hashes, owner, 1)[0]))
        # Of each template: for every word with a digit, the places of the shingles that hold it.
        self.versions = [self._versions(texts[name], wanted) for name, wanted in zip(self.names, self.sets)]
        # Templates that share much of it but not all, and which of its shingles are not theirs.
        self.rivals: list[list[tuple[int, np.ndarray]]] = []
        for i, one in enumerate(self.sets):
            own = [(j, ~np.isin(one, other)) for j, other in enumerate(self.sets) if j != i]
            self.rivals.append([(j, only) for j, only in own if 0 < only.sum() <= 0.5 * len(one)])
        sizes = [len(s) for s in self.sets]
        self.scales: dict[int, list[int]] = {}
        for number, size in enumerate(sizes):
            self.scales.setdefault(scale_of(size), []).append(number)
        self.bands = {s: max(bands_for(sizes[i], containment, miss) for i in some) for s, some in self.scales.items()}
        self.factors = factors(max(self.bands.values()))
        # Of each scale and band: the templates' values, and a table of their low bits.
        self.values: dict[int, np.ndarray] = {}
        self.low: dict[int, np.ndarray] = {}
        for scale, some in self.scales.items():
            short = [(self.sets[i] >> np.uint64(32)).astype(np.uint32) for i in some]
            self.values[scale] = np.array([[(x * f).min() for x in short] for f in self.factors[: self.bands[scale]]])
            self.low[scale] = np.zeros((self.bands[scale], 1 << 16), bool)
            for band, values in enumerate(self.values[scale]):
                self.low[scale][band, values & np.uint32(0xFFFF)] = True

    @staticmethod
    def _versions(text: str, wanted: np.ndarray) -> list[np.ndarray]:
        data, offsets = tk.text_bytes(pa.array([text]))
        hashes, owner, start = tk.word_hashes(data, offsets)
        place = np.searchsorted(wanted, tk.shingles(hashes, owner, 1)[0])
        inside = tk.word_bytes()[data]
        found = []
        for word, at in enumerate(start):
            end = at + int(np.argmin(np.append(inside[at:], False)))
            if any(ord("0") <= c <= ord("9") for c in data[at:end]):
                found.append(np.unique(place[max(word - 4, 0) : word + 1]))
        return found

    def _wrong(self, number: int, seen: np.ndarray, sh: np.ndarray, a: int, b: int, low: int, high: int) -> bool:
        """True if a partial match lacks a version number, or is a better match of a rival and nothing else."""
        if any(not seen[some].any() for some in self.versions[number]):
            return True
        for rival, only in self.rivals[number]:
            if not seen[only].any():
                around = len(self.sets[rival])
                there = np.isin(self.sets[rival], sh[max(a - around, low) : min(b + around, high)])
                if there.mean() > seen.mean():
                    return True
        return False

    def candidates(self, sh: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Template, first and end shingle of windows that share a band with it."""
        top = max(self.scales)
        size = -(-len(sh) // (2 * top)) * 2 * top
        short = (sh >> np.uint64(32)).astype(np.uint32)
        found: set[tuple[int, int, int]] = set()
        for band, factor in enumerate(self.factors):
            least = np.full(size, 0xFFFFFFFF, np.uint32)
            np.multiply(short, factor, out=least[: len(sh)])
            scale = 1
            while True:
                if scale in self.scales and band < self.bands[scale]:
                    window = np.minimum(least[:-1], least[1:]) if len(least) > 1 else least
                    for at in np.flatnonzero(self.low[scale][band][window & np.uint32(0xFFFF)]):
                        for number in np.flatnonzero(self.values[scale][band] == window[at]):
                            found.add((self.scales[scale][number], int(at) * scale, (int(at) + 2) * scale))
                if scale >= top:
                    break
                least = np.minimum(least[0::2], least[1::2])
                scale *= 2
        yield from sorted(found)

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, float, int]]:
        """Text index, template, containment and first word of the best place."""
        texts = len(offsets) - 1
        hashes, owner, _ = tk.word_hashes(data, offsets)
        sh, of = tk.shingles(hashes, owner, texts)
        if not len(sh):
            return []
        edge = np.searchsorted(of, np.arange(texts + 1))
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for number, first, end in self.candidates(sh):
            wanted = self.sets[number]
            around = len(wanted)
            low, high = max(first - around, 0), min(end + around, len(sh))
            for text in range(of[low], of[high - 1] + 1):
                a, b = max(low, edge[text]), min(high, edge[text + 1])
                if b <= a:
                    continue
                place = np.minimum(np.searchsorted(wanted, sh[a:b]), len(wanted) - 1)
                hit = wanted[place] == sh[a:b]
                share = len(np.unique(place[hit])) / len(wanted)
                if share >= self.containment - 1e-9:
                    seen = np.zeros(len(wanted), bool)
                    seen[place[hit]] = True
                    if share < 1 and self._wrong(number, seen, sh, a, b, edge[text], edge[text + 1]):
                        continue
                    start = int(a + np.flatnonzero(hit)[0] - edge[text])
                    old = best.get((text, number), (0.0, 0))
                    if (share, -start) > (old[0], -old[1]):
                        best[text, number] = (share, start)
        return [(text, number, share, start) for (text, number), (share, start) in sorted(best.items())]


def scan_licenses(docs: DataFrame, notices: Mapping[str, str] = NOTICES, containment: float = CONTAINMENT, miss: float = MISS) -> DataFrame:
    """``doc_id``, ``license``, ``containment``, ``word`` (where the first shared shingle starts)."""
    tk.arrow_batches(docs.sparkSession)
    texts = dict(notices)
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("license", T.StringType()),
            T.StructField("containment", T.DoubleType()),
            T.StructField("word", T.LongType()),
        ]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(texts, containment, miss)
        for batch in batches:
            for part in tk.slices(batch, "text"):
                found = templates.matches(*tk.text_bytes(part.column("text")))
                if found:
                    text, number, share, start = zip(*found)
                    columns = [
                        part.column("doc_id").take(pa.array(text)), pa.array([templates.names[n] for n in number]),
                        pa.array(share, pa.float64()), pa.array(start, pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "license", "containment", "word"])

    return docs.select("doc_id", "text").mapInArrow(scan, schema)
