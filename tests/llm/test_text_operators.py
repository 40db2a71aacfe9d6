"""Chat, language, near copies, toxicity, licences and packing against brute force."""
from __future__ import annotations

import hashlib
import itertools
import math
import os
import random
import sys
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import SMALL, WORDS, check_packing, check_sequences, clashing, classes_by_brute_force, shingle_set, words
from pyspark.sql import functions as F

from chartlake.llm import chat, language, licenses, neardup, packing, queries, textkernels, toxicity

BYTES = public_tokenizers.path("byte_bpe_50k.json")
TURNS = "conv_id long, turn long, role string, text string"


# Chat


def chat_digest(rows) -> dict:
    by: dict = {}
    key = lambda v, low: (v is not None, low if v is None else v)
    for r in sorted(rows, key=lambda r: (key(r[0], 0), key(r[1], 0), key(r[2], ""), key(r[3], ""))):
        by.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    return {
        c: (
            len(v), sha("".join(f"{r}\n{t}\n" for r, t in v)),
            sum(len(t) for r, t in v if r == "assistant"), sha("".join(t for r, t in v if r == "assistant")),
        )
        for c, v in by.items()
    }


def got_digest(frame) -> dict:
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in frame.collect()}


def test_chat_query_reads_back_every_turn(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    out = queries.op1_chat(spark, SMALL)
    assert got_digest(out) == chat_digest(rows)
    assert all(r.formatted_chars > 0 and r.n_tokens > r.loss_tokens for r in out.collect())


@pytest.mark.parametrize("segment", [1 << 20, 40])
def test_chat_awkward_rows_and_segments(spark, segment):
    rows = [
        (None, None, None, None), (1, None, "user", "x"), (1, 2, "assistant", "é😀\\[INST][/INST]</s><|endoftext|>\\\\ [IN\\ST]"),
        (1, 2, "assistant", "twice"), (1, 2, "assistant", "twice"), (1, 3, "assistant", None), (1, 3, "tool[INST]", "</s"),
        (2, 1, "assistant", "  lead\n\n"), (4, 1, "assistant", "long words " * 30_000),
    ] + [(3, i, "assistant" if i % 2 else "user", f"turn {i} ") for i in range(300)]
    frame = clashing(spark.createDataFrame(rows, TURNS))
    segments = chat.format_conversations(frame, BYTES, segment_chars=segment)
    assert got_digest(chat.digests(segments)) == chat_digest(rows)
    whole = chat.Template().render([(r[2] or "", r[3] or "") for r in sorted(rows[9:], key=lambda r: r[1])])[0]
    ids = chat.encoder(open(BYTES).read(), chat.Template()).encode(whole, add_special_tokens=False).ids
    parts = segments.where("conv_id = 3").orderBy("part", "seq").collect()
    assert [i for p in parts for i in p.input_ids] == ids
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], TURNS), BYTES)).count() == 0


@given(st.text(alphabet="[]/INST<>s\\|endoftx ab", max_size=40))
def test_chat_escape_is_reversible(text):
    template = chat.Template()
    escaped = template.escape(text)
    assert not any(c in escaped for c in template.controls)
    assert template.unescape(escaped) == text


# Language


def test_language_accuracy_on_held_out_texts(spark):
    out = queries.op2_language(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id"
    ).collect()
    held = [r for r in out if r.held_out]
    assert len(out) == 1000 and len(held) > 150
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_language_kernel_is_the_share_of_common_grams():
    texts = ["banana bandana", "ananas", "", "b", "zzzz"]
    data, offsets = textkernels.text_bytes(pa.array(texts))
    seen = np.zeros(1 << language.PLACES, bool)
    for n in language.LENGTHS:
        for a, b in zip(offsets, offsets[1:]):
            seen[language._places(data[a:b], n)] = True
    column = np.full(len(seen), seen.sum(), np.int32)
    column[seen] = np.arange(seen.sum())
    marks = language.presence(data, offsets, column, int(seen.sum()))[:, :-1]
    marks = marks / np.sqrt(np.maximum(marks.sum(1, keepdims=True), 1))
    got = language.kernels(data, offsets, column, marks.T.copy())

    def grams(t):
        return {t[i : i + n] for n in language.LENGTHS for i in range(len(t) - n + 1)}

    for i, j in itertools.product(range(5), repeat=2):
        x, y = grams(texts[i]), grams(texts[j])
        assert got[i, j] == pytest.approx(len(x & y) / max(1, len(x) * len(y)) ** 0.5, abs=1e-5)


def languages_by_brute_force(rows, landmarks: int = 16, ridge: float = 1e-2):
    """Predictions from the kernel matrix: ``rows`` are id, text, label, order of the row and whether to learn from it."""

    def place(gram: bytes) -> int:
        value = len(gram)
        for b in gram:
            value = (value * 0x01000193 + b) % 2**32
        return (value * 0x9E3779B1) % 2**32 >> (32 - language.PLACES)

    def presence(text):
        data = (text or "").lower().encode()
        return {place(data[i : i + n]) for n in language.LENGTHS for i in range(len(data) - n + 1)}

    known = [r for r in rows if r[4] and r[2] is not None and any(c.isalpha() for c in r[1] or "")]
    names = sorted({r[2] for r in known})
    low, high = language.LANDMARK_CHARS
    marks = []
    for name in names:
        mine = sorted((not low <= len(r[1]) <= high, r[3], r[1]) for r in known if r[2] == name)
        marks += [presence(text) for *_, text in mine[:landmarks]]
    every = set().union(*marks)

    def kernel(text):
        own = presence(text) & every
        return np.array([len(own & m) / math.sqrt(max(len(own), 1) * max(len(m), 1)) for m in marks])

    K, W = np.stack([kernel(r[1]) for r in known]), np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(W)
    keep = values > 1e-6 * values[-1]
    inverse = (vectors[:, keep] / values[keep]) @ vectors[:, keep].T
    center = K.mean(0)
    gram = (K - center) @ inverse @ (K - center).T
    Y = np.array([[1.0 if r[2] == name else -1.0 for name in names] for r in known])
    dual = np.linalg.solve(gram + ridge * len(K) * np.eye(len(K)) / 10, Y - Y.mean(0))
    result = {}
    for i, text, *_ in rows:
        power = language.SHARPNESS * (Y.mean(0) + (kernel(text) - center) @ inverse @ (K - center).T @ dual)
        power = np.exp(power - power.max())
        power /= power.sum()
        fine = any(c.isalpha() for c in text or "")
        result[i] = (names[power.argmax()], power.max(), np.sort(power)[-2]) if fine else ("und", 0.0, 0.0)
    return result


def test_language_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.select("doc_id", "text", "lang", F.xxhash64("doc_id", "text", "lang").alias("order")).collect()
    learn = [zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in rows]
    want = languages_by_brute_force([(*r, k) for r, k in zip(rows, learn)])
    out = queries.op2_language(spark, SMALL).collect()
    assert len(out) == len(rows) == len(want)
    for r in out:
        name, score, second = want[r.doc_id]
        assert r.score == pytest.approx(score, abs=5e-3)
        assert r.lang_pred == name or score - second < 1e-2


def test_language_awkward_rows(spark, documents, awkward, empty):
    model = language.fit(documents.unionByName(awkward).select("doc_id", "text", "lang"))
    out = language.classify(clashing(awkward), model).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 10
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (-1, -2, -3, -4))
    assert by[-6].lang_pred == "de"
    assert language.fit(empty) is None
    assert {r.lang_pred for r in language.classify(awkward, None).collect()} == {"und"}
    assert language.classify(empty, model).count() == 0
    single = language.fit(documents.where("lang = 'fr'"))
    assert {(r.lang_pred, r.score) for r in language.classify(documents, single).collect()} == {("fr", 1.0)}


def test_language_learns_the_most_frequent_labels(spark, documents):
    odd = documents.withColumn("lang", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("odd"), "doc_id")).otherwise(F.col("lang")))
    model = language.fit(odd.select("doc_id", "text", "lang"), labels=4)
    assert model.languages == ["de", "en", "es", "fr"]
    assert len(language.fit(odd.select("doc_id", "text", "lang"), labels=20).languages) == 20


def test_language_stage_keeps_documents_without_any_label(spark, documents, awkward):
    bare = awkward.withColumn("lang", F.lit(None).cast("string"))
    out = corpus_pipeline.identify_language(spark, bare, SMALL).collect()
    assert sorted(r.doc_id or 0 for r in out) == [-8, -7, -7, -6, -5, 0] and {r.lang for r in out} == {None}
    out = corpus_pipeline.identify_language(spark, documents.unionByName(awkward), SMALL)
    assert out.where("doc_id in (-1, -2, -3, -4)").count() == 0 and out.where("lang is null").count() == 0


# Near copies


def test_near_duplicates_query_equals_brute_force(spark, documents):
    want = classes_by_brute_force({r.doc_id: r.text for r in documents.collect()})
    out = queries.op3_near_duplicates(spark, SMALL).collect()
    assert {r.doc_id: r.class_id for r in out} == want
    assert all(r.kept == (r.doc_id == r.class_id) for r in out)
    assert len(set(want.values())) < len(want)


def test_near_duplicates_find_a_family_in_small_blocks(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    texts = {}
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randrange(1, 6)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        texts[i] = " ".join(copy)
    texts |= {200 + i: " ".join(f"y{rng.randrange(10**6)}" for _ in range(60)) for i in range(30)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    small = neardup.search_blocks
    monkeypatch.setattr(neardup, "search_blocks", lambda m, s, t: small(m, s, t, block=16))
    out = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    assert out == classes_by_brute_force(texts)


def test_near_duplicates_awkward_rows(awkward, empty):
    out = neardup.near_duplicates(clashing(awkward)).collect()
    assert len(out) == 10
    by = {r.doc_id: r for r in out}
    assert by[-7].class_id == by[-8].class_id == -8 and by[-8].kept and not by[-7].kept
    assert all(by[i].class_id == i and by[i].kept for i in (-1, -2, -3, -4, -5, -6))
    assert by[None].class_id is None and by[None].kept
    assert neardup.near_duplicates(empty).count() == 0


def test_signatures_estimate_the_probability_jaccard():
    rng = np.random.default_rng(1)
    names = textkernels.mix(np.arange(60, dtype=np.uint64))
    x, y = rng.uniform(0.5, 4, 40), rng.uniform(0.5, 4, 40)
    sh, owner = np.concatenate([names[:40], names[20:]]), np.repeat([0, 1], 40)
    sign = neardup.prob_minhash(sh, owner, np.concatenate([x, y]), 2, 4000)
    p, q = np.zeros(60), np.zeros(60)
    p[:40], q[20:] = x, y
    both = (p > 0) & (q > 0)
    want = sum(1 / np.maximum(p / p[i], q / q[i]).sum() for i in np.flatnonzero(both))
    assert (sign[0] == sign[1]).mean() == pytest.approx(want, abs=0.03)


def test_near_duplicates_with_a_passage_that_one_text_repeats():
    rng = random.Random(8)
    missed_before = 0
    for i in range(40):
        line = " ".join(f"l{i}x{k}" for k in range(50))
        body = " ".join(f"w{i}x{rng.randrange(10**6)}" for _ in range(200))
        one, many = f"{line} {line} {body}", f"{line} " * 1000 + body
        assert shingle_set(one) == shingle_set(many)
        sh, of, count, *_ = neardup.weighted_shingles(*textkernels.text_bytes(pa.array([one, many])))
        keys, has = neardup.bucket_keys(sh, of, count, 2, neardup.BANDS, neardup.BAND_ROWS)
        assert set(keys[has == 0]) & set(keys[has == 1])
        weighted = neardup.band_keys(neardup.prob_minhash(sh, of, 1 + np.log(count), 2, 130), neardup.BANDS, neardup.BAND_ROWS)
        missed_before += not set(weighted[0]) & set(weighted[1])
    assert missed_before > 0


def test_repeated_ids_with_different_texts(spark, awkward):
    """Rows of one id are one document in classes; the pipeline's stage keeps every text."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = b + " tail"
    schema = "doc_id long, text string, lang string, source string, n_chars long"

    def frame(*pairs):
        return spark.createDataFrame([(i, t, None, s, 0) for i, t, *rest in pairs for s in (rest or ["s"])], schema)

    def classes(df):
        return sorted({(r.doc_id, r.class_id, r.kept) for r in neardup.near_duplicates(df).collect()})

    def kept(df):
        return sorted((r.doc_id or 0, r.text or "") for r in corpus_pipeline.drop_near_copies(spark, df, "").collect())

    four = frame((1, a), (2, a), (2, b), (3, c))
    assert classes(four) == [(1, 1, True), (2, 1, False), (3, 3, True)]
    assert kept(four) == [(1, a), (2, b), (3, c)] == kept(four.orderBy(F.desc("doc_id")))
    # Several texts of one smallest id, copies of each, repeated rows, near copies under one id.
    more = frame((5, a), (5, b), (5, c), (5, a), (6, b), (7, near), (8, c), (9, "x y z"), (5, near), (9, "x y z", "s", "t"), (4, None), (4, "..."), (4, None))
    assert classes(more) == [(4, 4, True), (5, 5, True), (6, 5, False), (7, 5, False), (8, 5, False), (9, 9, True)]
    got = kept(more)
    texts = [t for _, t in got]
    assert a in texts and c in texts and (b in texts) != (near in texts) and len(got) == 6
    assert [t for i, t in got if i == 4].count("...") == 1 and texts.count("x y z") == 1
    twice = four.unionByName(four)
    assert kept(twice) == kept(four) and classes(twice) == classes(four)
    assert len(kept(awkward)) == len({(r.doc_id, r.text) for r in awkward.collect()}) - 1  # one near copy


# Toxicity


def test_toxicity_accuracy_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    out = queries.op4_toxicity(spark, folder).join(
        spark.read.parquet(f"{folder}/labels.parquet").where("toxic is not null").select("doc_id", "toxic"), "doc_id"
    ).where("held_out").collect()
    hit = sum(r.toxic == r.predicted == 1 for r in out)
    assert hit / sum(r.predicted for r in out) > 0.95
    assert hit / sum(r.toxic for r in out) > 0.9


def toxicity_by_brute_force(texts: dict[int, str], labels: list[tuple[int, int]], k: int) -> dict:
    """Scores and neighbours when all labelled documents are examples."""

    def counts(text):
        found = Counter()
        for w in words(text):
            found[w] += 1
            for n in toxicity.PREFIXES:
                if len(w.encode()) > n:
                    found[w.encode()[:n]] += 1
        return found

    bags = {i: counts(t) for i, t in texts.items()}
    examples = [(i, y) for i, y in labels if i in bags]
    sizes = Counter(y for _, y in labels)
    of = Counter(y for _, y in examples)
    vocabulary = {w for i, _ in examples for w in bags[i]}
    frequency = Counter(w for b in bags.values() for w in b if w in vocabulary)
    toxic = Counter(w for i in {i for i, y in examples if y} for w in bags[i])
    clean = Counter(w for i in {i for i, y in examples if not y} for w in bags[i])
    p, n = len({i for i, y in examples if y}), len({i for i, y in examples if not y})
    weight = {}
    for w in vocabulary:
        a, b, share = toxic[w], clean[w], (toxic[w] + clean[w]) / (p + n)
        pairs = ((a, share * p), (b, share * n), (p - a, (1 - share) * p), (n - b, (1 - share) * n))
        ratio = 2 * sum(x * math.log(x / e) for x, e in pairs if x)
        extra = math.sqrt(max(ratio - 2 * math.log(len(vocabulary)), 0) / (p + n))
        weight[w] = (math.log((1 + len(bags)) / (1 + frequency[w])) + 1) * (toxicity.FLOOR + extra)

    def unit(bag):
        v = {w: (1 + math.log(c)) * weight[w] for w, c in bag.items() if w in vocabulary}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    vectors, prior = [(i, y, unit(bags[i])) for i, y in examples if bags[i]], sizes[1] / sum(sizes.values())
    result = {}
    for i, bag in bags.items():
        mine = unit(bag)
        near = [(-round(sum(x * v.get(w, 0) for w, x in mine.items()), 12), j, y) for j, y, v in vectors]
        near = sorted(r for r in near if r[0] < 0)[:k]
        votes = [s**toxicity.SHARPNESS * sizes[y] / of[y] for s, _, y in near]
        top = sum(v for v, (_, _, y) in zip(votes, near) if y) + toxicity.PRIOR_VOTES * prior
        result[i] = (top / (sum(votes) + toxicity.PRIOR_VOTES), near)
    return result


def test_toxicity_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    known = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    want = toxicity_by_brute_force(docs, known, toxicity.NEIGHBOURS)
    out = queries.op4_toxicity(spark, SMALL).collect()
    assert len(out) == len(docs) and {y for _, y in known} == {0, 1}
    for r in out:
        score, near = want[r.doc_id]
        assert r.score == pytest.approx(score, abs=1e-9) and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        least = -near[-1][0] if near else 0.0
        sure = [j for s, j, _ in near if -s > least + 1e-9]  # equal ones may differ in the last digit
        assert set(sure) <= set(r.evidence) and len(r.evidence) == len(near)


@pytest.mark.parametrize("common", [0, 4, 1000])
def test_index_equals_all_pairs_cosine(common):
    rng = np.random.default_rng(3)
    dense = rng.exponential(size=(500, 30)) * (rng.random((500, 30)) < 0.2)
    dense[:, 29] = 1
    dense /= np.sqrt((dense * dense).sum(1, keepdims=True))
    vectors = [(np.flatnonzero(d), d[d > 0]) for d in dense]
    ids = rng.permutation(500)
    index = toxicity.Index.build(ids, np.zeros(500), np.ones(500), vectors, 30, common)
    found = index.nearest([(np.flatnonzero(d), d[d > 0]) for d in dense[:60]], 15)
    for d, (places, values) in zip(dense, found):
        score = np.round(dense @ d, 12)
        best = np.lexsort((ids, -score))[:15]
        assert index.ids[places].tolist() == ids[best].tolist() and np.allclose(values, score[best])


def test_toxicity_awkward_rows(spark, documents, awkward, empty):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    odd = labels.unionByName(spark.createDataFrame([(None, 1), (-5, None), (1, 0), (1, 1)], "doc_id long, label int"))
    docs = documents.unionByName(awkward)
    out = toxicity.score_documents(clashing(docs), odd).collect()
    assert len(out) == 210 and all(0 <= r.score <= 1 for r in out)
    blank = {r.score for r in out if r.doc_id in (-1, -2, -3)}
    assert len(blank) == 1
    assert {r.score for r in toxicity.score_documents(docs, odd.where("false")).collect()} == {0.0}
    assert toxicity.score_documents(empty, odd).count() == 0


def test_toxicity_evidence_counts_labels_outside_of_the_sample(spark):
    rng = random.Random(6)
    rows = []
    for i in range(800):
        words = [f"n{rng.randrange(300)}" for _ in range(30)]
        rows.append((i, " ".join([*words, "zorgle"] if i < 40 else words), int(i < 400)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, "n1 n2 zorgle"), (901, "n1 n2")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, label) for i, _, label in rows], "doc_id long, label int")
    by = {r.doc_id: r for r in toxicity.score_documents(docs, labels, examples=100).collect()}
    assert by[900].evidence and by[900].score > 0.7 and by[901].score < 0.7


# Licences


def test_licenses_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    out = {(r.doc_id, r.license) for r in queries.op7_licenses(spark, "/root/testdata/sf0.01").collect()}
    wanted = {n: shingle_set(t) for n, t in licenses.NOTICES.items()}
    sets = {r.doc_id: shingle_set(r.text) for r in docs}
    want = {(i, n) for i, s in sets.items() for n, w in wanted.items() if len(s & w) >= 0.8 * len(w)}
    assert out == want and out


def test_licenses_edited_and_awkward_texts(spark, awkward, empty):
    rng = random.Random(1)
    rows = []
    for i, (name, text) in enumerate(licenses.NOTICES.items()):
        words = text.split()
        if len(words) > 60:
            del words[rng.randrange(20, 40)]
        rows.append((i, "lead in " * rng.randrange(300) + " ".join(words).upper() + " and more" * 50))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = licenses.scan_licenses(clashing(docs)).collect()
    found = {(r.doc_id, r.license) for r in out}
    assert {(i, n) for i, n in enumerate(licenses.NOTICES)} <= found
    assert all(r.containment >= 0.8 for r in out)
    assert licenses.scan_licenses(awkward).count() == 0
    assert licenses.scan_licenses(empty).count() == 0


def test_licenses_of_other_versions_and_families(spark):
    notice = licenses.NOTICES["GPL-3.0-notice"]
    cases = {
        "This work is licensed under the GNU General Public License, version 2": {"GPL-2.0"},
        "This work is licensed under the GNU General Public License, version 3": {"GPL-3.0"},
        "This work is licensed under the GNU General Public License, version 7": set(),
        notice: {"GPL-3.0-notice"},
        notice.replace("3", "2").replace("software:", "software;"): {"GPL-2.0-notice"},
        notice.replace("version 3", "version 4"): set(),
        notice.replace("General", "Lesser General"): {"LGPL-3.0-notice"},
        notice.replace("General", "Affero General"): {"AGPL-3.0-notice"},
        notice.replace("option", "choice"): {"GPL-3.0-notice"},
        notice.replace("General", "Lesser General").replace("3", "2.1").replace("program", "library"): {"LGPL-2.1-notice"},
        notice + " between " * 80 + licenses.NOTICES["LGPL-3.0-notice"]: {"GPL-3.0-notice", "LGPL-3.0-notice"},
        "Made available under the terms of the Eclipse Public License 2.0 here": {"EPL-2.0"},
        "This is licensed under a Creative Commons Attribution 3.0 Unported License": {"CC-BY-3.0"},
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    found: dict = {i: set() for i in range(len(cases))}
    for r in licenses.scan_licenses(docs).collect():
        found[r.doc_id].add(r.license)
    assert list(found.values()) == list(cases.values())


def test_license_bands_bound_the_miss_probability():
    for n in range(1, 200):
        need, scale = licenses.needed(n), licenses.scale_of(n)
        similarity = need / (2 * scale + n - need)
        assert (1 - similarity) ** licenses.bands_for(n) <= licenses.MISS * (1 + 1e-9)


# Packing


def test_pack_query_equals_the_tokenizer(spark, documents):
    rows = queries.op6_pack(spark, SMALL).collect()
    check_packing(rows, {r.doc_id: r.text for r in documents.collect()})


def test_pack_awkward_rows(spark, awkward, empty):
    odd = "It's A test\t<|endoftext|>x <|STARTOFTEXT|> don't É é ΣΑΣ 12 ３ ²\r\nfoo\x85bar\x1cbaz  a　b 'Re we'LL!!! … …. ÷. ×, J̌"
    docs = awkward.where("doc_id <> -7 and doc_id is not null").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(9, odd)], docs.schema))
    rows = packing.pack_documents(clashing(docs), WORDS).collect()
    check_packing(rows, {r.doc_id: r.text for r in docs.collect()})
    assert packing.pack_documents(empty, WORDS).count() == 0
    repeated = packing.pack_documents(awkward.where("doc_id = -7 or doc_id is null"), WORDS).collect()
    assert len(repeated) == 3
    check_sequences(repeated)


@settings(max_examples=60)
@given(st.text(alphabet="aB'sS.,!? \nÉé…»÷×́３9<|endoftext>", max_size=60))
def test_words_encode_as_the_whole_text(text):
    encode = packing.encoder(open(WORDS, encoding="utf-8").read())
    ids = np.frombuffer(encode([text])[0], "<u4").tolist()
    tokenizer = packing.sys.modules["_packing_state"].tokenizer
    assert ids == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


@given(st.lists(st.integers(1, 64), max_size=200))
def test_best_two_fit_packs_everything(lengths):
    bins, offsets = packing.best_two_fit(np.array(lengths, np.int64), 64)
    for b in set(bins.tolist()):
        inside = sorted((offsets[i], lengths[i]) for i in np.flatnonzero(bins == b))
        at = 0
        for offset, length in inside:
            assert offset == at
            at += length
        assert at <= 64


def test_best_two_fit_replaces_the_smallest():
    # Greedy alone takes 60 + 35 (gap 5); two pieces, 20 + 20, fit the gap of 40 exactly.
    bins, _ = packing.best_two_fit(np.array([60, 35, 20, 20]), 100)
    assert bins[0] == bins[2] == bins[3] != bins[1]


def test_word_cache_is_bounded_in_bytes(monkeypatch):
    """Long unbroken words, as of languages without spaces, don't pile up."""
    import sys

    monkeypatch.setattr(packing, "CACHE_BYTES", 1 << 20)
    with open(WORDS, encoding="utf-8") as file:
        encode = packing.encoder(file.read())
    state = sys.modules["_packing_state"].__dict__
    state["known"].clear()
    state["known"][b""], state["bytes"] = b"", 0
    largest = 0
    for i in range(5000):
        (ids,) = encode([f"{i}" + "\u4e2d\u6587" * 100])
        assert len(ids) > 8
        held = sum(len(w) + len(v) for w, v in state["known"].items())
        assert held <= state["bytes"] + 4
        largest = max(largest, held)
    assert largest < (1 << 20) + 10_000


def test_words_dropped_are_learned_again(monkeypatch):
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    with open(WORDS, encoding="utf-8") as file:
        definition = file.read()
    before = packing.encoder(definition)
    ids = before(["some words", "some others"])
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
    textkernels.drop_words()
    assert "_packing_state" not in sys.modules
    textkernels.drop_words()
    assert packing.encoder(definition)(["some words", "some others"]) == ids == before(["some words", "some others"])


def test_tasks_of_other_operators_drop_the_words_kept(spark):
    """Workers go from packing to other operators; what they knew of words goes."""
    rows = [(i, f"word{i} and more", "en") for i in range(640)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(64).cache()

    def look(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"held": ["_packing_state" in sys.modules]})

    def held():
        return sum(r.held for r in docs.select("doc_id").mapInArrow(look, "held boolean").collect())

    for other in (language.classify(docs, None), neardup.signatures(docs), neardup.contents(docs)):
        packing.encode_pieces(docs, WORDS).write.format("noop").mode("overwrite").save()
        assert held() > 0
        other.write.format("noop").mode("overwrite").save()
        assert held() == 0
