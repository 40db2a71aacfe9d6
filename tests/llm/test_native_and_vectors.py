"""Personal data, mixing, vectors, the registered queries and the pipeline."""
from __future__ import annotations

import hashlib
import itertools
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import DOCS, SMALL, WORDS, check_packing, check_sequences, clashing, classes_by_brute_force
from pyspark.sql import functions as F

import corpus_pipeline
from chartlake.llm import embdup, mixing, neardup, packing, pii, queries, topk
from checks.compare import compare, duck


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    cursor = duck(SMALL).execute(queries.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert compare(df.columns, df.collect(), columns, cursor.fetchall()) == ""


# Personal data


def luhn(value: str) -> bool:
    digits = [int(c) for c in re.sub("[^0-9]", "", value)][::-1]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


def n_digits(value: str) -> int:
    return len(re.sub("[^0-9]", "", value))


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= n_digits(v) <= 19 and luhn(v)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= n_digits(v) <= 15),
]


def base_spans(text: str | None) -> list[str]:
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in BASE for m in re.finditer(p, text or "") if ok(m[0])]


def test_pii_awkward_texts(spark, awkward, empty):
    rng = random.Random(2)
    pieces = ["a", "@", ".", "-", "+", "1", "22", "255", "256", " ", "x.y", "(", ")", "4111111111111111", "é", "😀", "%"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += ["4" * 30_000, "1.2.3." * 2000, "@" + "a" * 20_000, "+1 " + "2 " * 5000, None, "0001.2.3.255 999.1.1.1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.digest(pii.find_pii(clashing(docs))).collect():
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if not s.startswith("iban")] == (want or [""]) or not want
        assert r.n_email == sum(s.startswith("email") for s in want)
    assert pii.digest(pii.find_pii(awkward)).count() == 10
    assert pii.digest(pii.find_pii(empty)).count() == 0


def test_pii_score_iban_and_redaction(spark):
    text = "pay IBAN DE89 3704 0044 0532 0130 00 or DE88 3704 0044 0532 0130 00; mail a@b.co, call +49 (0)151 234-5678"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    spans = {s.kind: s for s in pii.find_pii(docs).where("doc_id = 1").first().pii}
    assert spans["iban"].value == "DE89 3704 0044 0532 0130 00" and spans["iban"].score == pytest.approx(0.9)
    assert spans["email"].score == pytest.approx(1.0)
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[1].startswith("pay IBAN <IBAN> or") and clean[1].endswith("mail <EMAIL>, call <PHONE>") and clean[2] is None


def test_pii_iban_before_and_behind_upper_case_words(spark):
    gb, spaced, de = "GB29NWBK60161331926819", "GB29 NWBK 6016 1331 9268 19", "DE89370400440532013000"
    cases = [
        (f"{gb} BIC NWBKGB2L", [gb]), (f"{de} EUR 50", [de]), (f"{spaced} UK", [spaced]), (f"REF12 {spaced}", [spaced]),
        (f"DE88370400440532013000 {de} {gb}", [de, gb]), (f"é {de}{gb}", [de, gb]), ("DE88370400440532013000 EUR 50", []),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    for r in pii.find_pii(docs).collect():
        spans = [s for s in r.pii if s.kind == "iban"]
        assert [s.value for s in spans] == cases[r.doc_id][1]
        assert all(r.text[s.start : s.end] == s.value for s in spans)
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[0] == "<IBAN> BIC NWBKGB2L" and clean[1] == "<IBAN> EUR 50" and clean[5] == "é <IBAN><IBAN>"


def test_pii_query_equals_sql_on_account_numbers(spark, tmp_path):
    gb, spaced, de = "GB29NWBK60161331926819", "GB29 NWBK 6016 1331 9268 19", "DE89370400440532013000"
    bad = "DE88370400440532013000"
    rng = random.Random(9)
    parts = [gb, spaced, de, bad, "EUR 50", "BIC NWBKGB2L", "UK", "a", "é", "IBAN", "REF12", "ZZ82" + "A" * 20, "NO9386011117947", ",", "bank"]
    texts = [rng.choice(["", " "]).join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(300)] + [None, "", gb + " " + "A1 " * 40]
    folder = str(tmp_path)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents")
    con = duck(folder)
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents/*.parquet')")
    docs = spark.read.parquet(f"{folder}/documents")
    out = pii.digest(pii.find_pii(docs))
    cursor = con.execute(queries.ORACLES["op8_pii"])
    columns = [c[0] for c in cursor.description]
    rows = out.collect()
    assert compare(out.columns, rows, columns, cursor.fetchall()) == ""
    assert sum("iban" in r.spans for r in rows) > 100


# Mixing


def test_mix_targets_and_repeats(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", "c", "d", None]) if i % 3 else "a", rng.randrange(0, 50)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    out = mixing.plan_mix(clashing(docs)).collect()
    assert len(out) == 2000
    sizes, taken, target = {}, {}, {}
    for r in out:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r.size and r.taken % max(r.size, 1) == 0
    assert all(r.source_size == sizes[r.source] for r in out)
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    weights = dict(zip([*sorted(s for s in sizes if s), None], itertools.cycle((5, 2, 1))))
    open_ = [s for s in sizes if target[s] < 2 * sizes[s] - 1e-6]
    level = {target[s] / weights[s] for s in open_}
    assert max(level) - min(level) < 1e-6 and all(2 * sizes[s] / weights[s] <= max(level) + 1e-6 for s in sizes if s not in open_)
    assert all(abs(taken[s] - target[s]) <= 25 for s in sizes)
    again = mixing.plan_mix(docs).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in out}


def test_mix_positions_follow_the_demand(spark):
    rows = [(i, "abc"[i % 3], 1) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    mixed = mixing.mix(docs).select("source", "position").collect()
    assert all(0 <= r.position <= 1 for r in mixed)
    for number, source in enumerate("abc"):
        (t0, w0), (t1, w1) = mixing.CURRICULUM[number]
        times = sorted(r.position for r in mixed if r.source == source)
        for t in (0.25, 0.5, 0.75):
            share = (w0 * t + (w1 - w0) * t * t / 2) / ((w0 + w1) / 2)
            assert np.searchsorted(times, t) / len(times) == pytest.approx(share, abs=0.01)
    stored = mixing.mix(docs)
    edges = stored.select(F.spark_partition_id().alias("p"), "position").groupBy("p").agg(F.min("position").alias("a"), F.max("position").alias("b"))
    edges = sorted(edges.collect())
    assert all(x.b <= y.a for x, y in zip(edges, edges[1:]))


@given(st.floats(0.001, 1), st.lists(st.tuples(st.floats(0.05, 1), st.floats(0, 5)), min_size=1, max_size=4))
def test_demand_areas_grow(share, steps):
    knots, t = [(0.0, 1.0)], 0.0
    for width, weight in steps:
        t += width
        knots.append((t, weight))
    area = mixing.areas(knots)
    assert all(a <= b for a, b in zip(area, area[1:]))


def test_demand_inverts_through_all_segments(spark):
    knots = ((0.0, 1.0), (0.3, 4.0), (0.6, 0.5), (1.0, 0.5))
    shares = [0.0, 0.05, 0.3, 0.5, 0.7, 0.9, 1.0]
    rows = spark.createDataFrame([(s,) for s in shares], "u double")
    got = [r.t for r in rows.select(mixing.invert_demand(F.col("u"), F.lit(0), [knots]).alias("t")).collect()]
    for u, t in zip(shares, got):
        area = sum(
            (min(t, t1) - t0) * (w0 + w0 + (w1 - w0) * (min(t, t1) - t0) / (t1 - t0)) / 2
            for (t0, w0), (t1, w1) in zip(knots, knots[1:]) if t > t0
        )
        assert area / mixing.areas(knots)[-1] == pytest.approx(u, abs=1e-9)


def test_mix_awkward_rows(awkward, empty):
    sized = awkward.withColumn("size", mixing.word_count(F.col("text")))
    assert {r.doc_id: r.size for r in sized.collect()}[-1] == 0
    assert mixing.plan_mix(sized).count() == 10
    assert mixing.plan_mix(empty.withColumn("size", F.lit(0).cast("long"))).count() == 0
    assert mixing.mix(sized.where("size = 0")).count() == 0


# Vectors

VECTORS = "vec_id long, embedding array<float>, label int"
ODD_VECTORS = [
    (-1, None, None), (-2, [], 1), (-3, [0.0] * 8, 1), (-4, [1.0, None], 1), (-5, [float("nan")] * 8, 1), (-6, [1.0, 2.0], 1),
    (-7, [2.0, 4.0], 2), (-8, [1.0, 2.0], 1), (-8, [1.0, 2.0], 1), (-9, [float("inf")] + [1.0] * 7, 1), (None, [1.0, 2.0], 1),
]


def clustered(seed: int, groups: int, each: int, size: int = 8) -> list[tuple]:
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        center = rng.normal(size=size)
        for _ in range(each if g else each * 5):
            rows.append((len(rows), [float(x) for x in center + rng.normal(size=size) * 0.25], g))
    return rows


@pytest.mark.parametrize("home_rows", [16_384, 20])
def test_near_vectors_equal_brute_force(spark, home_rows):
    rows = clustered(3, 30, 12)
    docs = spark.createDataFrame(rows + ODD_VECTORS, VECTORS)
    out = embdup.near_vectors(clashing(docs), home_rows=home_rows).collect()
    assert len(out) == len(rows) + len(ODD_VECTORS)
    X = np.array([np.array(r[1], np.float32) for r in rows], float)
    X /= np.sqrt((X * X).sum(1, keepdims=True))
    near = X @ X.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(rows))
    while True:
        low = np.array([min([label[i], *label[near[i]]]) for i in range(len(rows))])
        if (low == label).all():
            break
        label = low
    got = {r.vec_id: (r.n_links, r.component_id) for r in out}
    assert all(got[i] == (int(near[i].sum()), int(label[i])) for i in range(len(rows)))
    assert near.sum() > 100
    assert all(got[i] == (0, i) for i in (-1, -2, -3, -4, -5, -9))
    assert got[-6] == got[-7] == got[-8] == (3, -8)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 300), st.integers(1, 6), st.integers(0, 3), st.integers(1, 9))
def test_cover_tree_invariants(seed, n, dims, spread, leaf):
    rng = np.random.default_rng(seed)
    x = rng.integers(-(10**spread), 10**spread + 1, size=(n, dims))
    tree = topk.CoverTree(x, leaf)
    apart = np.sqrt(((x[:, None, :] - x[None]) ** 2).sum(2))
    assert sorted(np.concatenate(tree.members).tolist()) == list(range(n)) and len(tree.levels[0].centers) == 1
    below = np.zeros(n, np.int64)
    for node, members in enumerate(tree.members):
        below[members] = node
    for i in range(len(tree.levels) - 1, -1, -1):
        level = tree.levels[i]
        own = apart[np.ix_(level.centers, level.centers)] + np.where(np.eye(len(level.centers)), np.inf, 0)
        assert (own > level.radius).all()  # separation
        assert (apart[:, level.centers].min(1) <= level.radius).all()  # covering of all points
        assert (apart[np.arange(n), level.centers[below]] <= level.reach[below]).all()
        if i:
            above = tree.levels[i - 1]
            assert set(above.centers) <= set(level.centers)  # nesting
            assert (apart[level.centers, above.centers[level.parent]] <= above.radius).all()  # covering of children
            assert above.radius >= 2 * level.radius
        below = level.parent[below]


def test_cover_tree_prunes_clustered_vectors(monkeypatch):
    monkeypatch.setattr(topk, "CHUNK", 128)
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(30, 6)) * 1000
    x = (centers[np.arange(3000) % 30] + rng.normal(size=(3000, 6))).astype(np.int64)
    found = topk.Search(np.arange(3000), x, 5)
    counted = []
    real = found._score
    found._score = lambda group, members: (counted.append(len(group) * len(members)), real(group, members))
    found.run(np.arange(100), x[:100], np.full(100, topk.NO_SCORE))
    assert sum(counted) < 0.8 * 100 * 3000
    counted.clear()
    kth = np.sort(x[:100] @ x.T, axis=1)[:, -6]
    found.run(np.arange(100), x[:100], kth)
    assert sum(counted) < 0.25 * 100 * 3000


@pytest.mark.parametrize("candidate_rows", [8192, 50])
def test_top_k_equals_brute_force(spark, candidate_rows):
    rows = clustered(7, 40, 10) + [(1000 + i, [0.5] * 8, 0) for i in range(30)]
    docs = spark.createDataFrame(rows + ODD_VECTORS, VECTORS)
    sample = 2048 if candidate_rows > 50 else 40  # a small one has no row of some lengths
    out = topk.top_k(clashing(docs), F.col("vec_id") % 10 == 0, candidate_rows=candidate_rows, sample_rows=sample).collect()
    ids = np.array([r[0] for r in rows])
    X = np.floor(1024 * np.array([np.array(r[1], np.float32) for r in rows], float)).astype(np.int64)
    want = set()
    for q in np.flatnonzero(ids % 10 == 0):
        score = X @ X[q]
        best = [c for c in np.lexsort((ids, -score)) if c != q][:10]
        want |= {(int(ids[q]), k + 1, int(ids[c]), int(score[c])) for k, c in enumerate(best)}
    assert {tuple(r) for r in out} == want


def test_vectors_empty_tables_and_large_components(spark):
    none = spark.createDataFrame([], VECTORS)
    assert embdup.near_vectors(none).count() == 0
    assert topk.top_k(none, F.col("vec_id") % 10 == 0).count() == 0
    big = spark.createDataFrame([(0, [1e6, 1.0], 0), (1, [1e6, 2.0], 0), (2, [-1e6, 3.0], 0)], "vec_id long, embedding array<double>, label int")
    got = [tuple(r) for r in topk.top_k(big, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1024_000_000**2 + 1024 * 2048), (0, 2, 2, -(1024_000_000**2) + 1024 * 3072)]
    few = topk.top_k(big.limit(1), F.col("vec_id") >= 0)
    assert few.count() == 0


# Pipeline


def test_pipeline_equals_brute_force(spark, documents):
    """Stages recomputed without the operators' methods, from the predecessor's rows."""
    docs = documents
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = neardup.materialize(stage(spark, docs, SMALL))
        kept[name] = out
        if name != "pack":
            assert out.columns == corpus_pipeline.COLUMNS
            docs = out
    before = {r.doc_id: r for r in documents.collect()}
    language = {r.doc_id: r for r in kept["language"].collect()}
    assert set(language) == {i for i, r in before.items() if any(c.isalpha() for c in r.text or "")}
    classes = classes_by_brute_force({i: r.text for i, r in language.items()})
    single = {r.doc_id: r for r in kept["near_duplicates"].collect()}
    assert set(single) == set(classes.values()) and kept["near_duplicates"].count() == len(single)
    for r in kept["personal_data"].collect():
        old = single[r.doc_id].text
        assert base_spans(r.text) == [] and r.n_chars == len(r.text)
        if not base_spans(old) and "<IBAN>" not in r.text:
            assert r.text == old
    mixed = kept["mix"].collect()
    clean = {r.doc_id: r.text for r in kept["personal_data"].collect()}
    planned = mixing.plan_mix(kept["personal_data"].withColumn("size", mixing.word_count(F.col("text")))).collect()
    copies = {r.doc_id: r.copies for r in planned if r.copies}
    counts = {}
    for r in mixed:
        assert r.text == clean[r.doc_id]
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert counts == copies
    packed = kept["pack"].collect()
    firsts = {}
    for r in packed:
        if r.piece == 0:
            firsts[r.doc_id] = firsts.get(r.doc_id, 0) + 1
    assert firsts == counts
    once = {}
    for r in packed:
        once.setdefault((r.doc_id, r.piece), r)
    texts = {i: clean[i] for i in counts}
    for i in texts:
        assert sum(r.length for (d, _), r in once.items() if d == i) > 0
    ran = corpus_pipeline.run(spark, SMALL)
    assert ran.columns == kept["pack"].columns and ran.count() == len(packed)


def test_pipeline_awkward_and_empty_documents(spark, awkward, empty):
    for start in (clashing(awkward), empty):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = neardup.materialize(stage(spark, docs, SMALL))
        assert (docs.count() > 0) == (start is not empty)
    check_packing(packing.pack_documents(awkward.where("doc_id = -5"), WORDS).collect(), {-5: "one"})


def test_language_found_rules_labels_and_packing(spark):
    """Wrong and missing labels get the language found, which keeps sequences apart; others stay."""
    words = {
        "en": "the house and that river were often with their early morning which should have been quiet".split(),
        "de": "der Fluss und das Haus waren nicht immer durch einen frühen Morgen zwischen schönen Bäumen".split(),
    }
    rng = random.Random(4)

    def text(lang):
        return " ".join(rng.choice(words[lang]) for _ in range(60))

    rows = [(i, text(lang), lang, "s", 0) for i in range(80) for lang in [("en", "de")[i % 2]]]
    held = next(i for i in range(102, 200) if zlib.crc32(str(i).encode()) % 4 == 2)
    rows += [(100, text("de"), "en", "s", 0), (101, text("en"), None, "s", 0), (held, text("de"), "xx", "s", 0), (None, text("de"), None, "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    found = {r.doc_id: r.lang for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert found.pop(held) == "xx" and found.pop(100) == "de" and found.pop(101) == "en" and found.pop(None) == "de"
    assert found == {i: ("en", "de")[i % 2] for i in range(80)}

    def ids(labels):
        packed = corpus_pipeline.pack_sequences(spark, spark.createDataFrame(labels, DOCS), "").collect()
        check_sequences([r for r in packed if r.lang == "en"])
        langs = {}
        for r in packed:
            langs.setdefault(r.sequence_id, set()).add(r.lang)
        assert all(len(x) == 1 for x in langs.values())
        return {(r.doc_id, r.piece, r.length, r.lang) for r in packed}

    apart = [(i, t, found.get(i), s, n) for i, t, _, s, n in rows]
    one, other = ids(apart), ids([(i, t, None, s, n) for i, t, _, s, n in rows])
    assert {x[:3] for x in one} == {x[:3] for x in other} and {x[3] for x in one} == {"en", "de", None}


def test_pieces_packed_by_a_column_keep_groups_small(spark):
    rows = [(i, 1 + i * 37 % 64, "abc"[i % 3] if i % 4 else None, i) for i in range(600)]
    pieces = neardup.materialize(spark.createDataFrame(rows, "doc_id long, length long, kind string, _of long"))
    packed = packing.pack(pieces, 64, 50, "kind").collect()
    assert len(packed) == 600 and {(r.doc_id, r.length, r.kind) for r in packed} == {row[:3] for row in rows}
    groups, bins = {}, {}
    for r in packed:
        groups.setdefault(r.sequence_id >> 31, []).append(r.kind)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(len(set(g)) == 1 and len(g) < 100 for g in groups.values()) and len(groups) == 12
    for inside in bins.values():
        ends = [0, *(o + n for o, n in sorted(inside))]
        assert [o for o, _ in sorted(inside)] == ends[:-1] and ends[-1] <= 64
    assert packing.pack(pieces.where("doc_id < 0"), 64, 50, "kind").count() == 0


def test_tasks_need_no_installed_package(tmp_path):
    """A job started from another folder ships the functions its tasks run."""
    code = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from chartlake import build_session\n"
        "from chartlake.llm import queries\n"
        "s = build_session('t', '2', 2)\n"
        "print('rows', queries.op7_licenses(s, sys.argv[2]).count(), queries.op2_language(s, sys.argv[2]).count())\n"
    )
    root = str(corpus_pipeline.__file__).rsplit("/", 1)[0]
    env = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code, root, SMALL], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows" in out.stdout, out.stderr[-2000:]
