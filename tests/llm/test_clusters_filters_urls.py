"""Centroid clustering, filter audit and URL rules against brute force."""
from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import DOCS, clashing
from pyspark.sql import functions as F

from chartlake.llm import centroids, filteraudit, urlrules

VECTORS = "vec_id long, embedding array<double>, label int"


# Centroids


def clusters_by_brute_force(rows, k, rounds, dims, scale=256):
    kept = [(i, tuple(int(np.floor(scale * c)) for c in v)) for i, v in rows if usable(v, dims, scale)]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), np.array(v, "<i8").tobytes(), v) for i, v in kept if i is not None)
    centers = [v for _, _, v in named[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers))

    for _ in range(rounds if centers else 0):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centers = [
            tuple(sum(x) // len(x) for x in zip(*groups[j])) if j in groups else c for j, c in enumerate(centers)
        ]  # Python's // is a floor
    return [(i, *nearest(v)[::-1]) for i, v in kept] if centers else [], centers


def usable(v, dims, scale):
    return (
        v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)
        and all(abs(np.floor(scale * c)) < centroids.REACH for c in v)
    )


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centers[i % 6] + 0.3 * rng.normal(size=8)]) for i in range(300)]
    rows += [(1000 + i, [0.25] * 8) for i in range(40)] + [(7, [0.5] * 8), (7, [-0.5] * 8)]
    odd = [
        (-1, None), (-2, []), (-3, [1.0, None] * 4), (-4, [float("nan")] * 8), (-5, [float("inf")] + [0.0] * 7), (-6, [1.0] * 7),
        (-7, [0.0] * 8), (-8, [1e30] + [0.0] * 7), (None, [0.1] * 8), (-9, [500_000.0] * 8),
    ]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows + odd], VECTORS)
    assigned, table = centroids.cluster_vectors(clashing(frame), k=9, rounds=3, dims=8)
    want, centers = clusters_by_brute_force(rows + odd, 9, 3, 8)
    got = [tuple(r) for r in assigned.select("vec_id", "cluster", "distance").collect()]
    order = lambda r: (r[0] is None, r)
    assert sorted(got, key=order) == sorted(want, key=order)
    assert {r["cluster"]: tuple(r["centroid"]) for r in table.collect()} == dict(enumerate(centers))
    for r in centroids.digest(assigned, table).collect():
        assert r.inertia == sum(d for *_, d in want)
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centers[r.cluster])).encode()).hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 12), st.integers(1, 5), st.integers(1, 6))
def test_threshold_walk_is_exact(seed, k, dims, spread):
    rng = np.random.default_rng(seed)
    centers = rng.integers(-spread, spread + 1, size=(k, dims))  # many ties
    x = rng.integers(-2 * spread, 2 * spread + 1, size=(30, dims))
    who, best, compared = centroids.Lists(centers).nearest(x)
    all_ = ((x[:, None, :] - centers[None]) ** 2).sum(2)
    assert (who == all_.argmin(1)).all() and (best == all_.min(1)).all() and compared <= 30 * k


def test_threshold_walk_stops_early():
    centers = np.arange(100)[:, None] * np.array([[10, 10, 10]])
    _, _, compared = centroids.Lists(centers).nearest(centers + 1)
    assert compared <= 4 * len(centers)  # of 100 each


def test_clusters_of_few_and_no_vectors(spark):
    none = spark.createDataFrame([], VECTORS)
    assigned, table = centroids.cluster_vectors(none, dims=2)
    assert centroids.digest(assigned, table).count() == 0 and table.count() == 0
    few = spark.createDataFrame([(1, [0.5, 1.0], 0), (1, [0.5, 1.0], 0)], VECTORS)
    got = centroids.digest(*centroids.cluster_vectors(few, dims=2)).collect()
    assert [(r.vec_id, r.cluster, r.distance, r.inertia) for r in got] == [(1, 0, 0, 0)] * 2
    nameless = spark.createDataFrame([(None, [0.5, 1.0], 0)], VECTORS)
    assert centroids.cluster_vectors(nameless, dims=2)[0].count() == 0  # no first centroid


# Filter audit


def failures(text: str) -> str:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
    out += "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text))
    return out + "D" * bool(re.search("[#$%&*|]", text))


def audit_by_brute_force(docs, labels):
    """Filters applied one after the other, in every order."""
    good = {i for i, q, t in labels if q == 1 and i is not None}
    toxic = {i for i, q, t in labels if t == 1 and i is not None}
    ids = {}
    for i, text, _ in docs:
        if i is not None:
            ids.setdefault(text or "", []).append(i)
    rows = []
    for i, text, source in docs:
        copy = i is not None and any(j < i for j in ids[text or ""])
        rows.append((source or "", failures(text or "") + "E" * copy, i in good, i in toxic))
    result, share = {}, {}
    for order in itertools.permutations("ABCDE"):
        for part in {r[0] for r in rows}:
            left = [r for r in rows if r[0] == part]
            mine = left
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                result[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == f for r in mine),
                    sum(r[2] for r in gone), sum(r[3] for r in gone),
                ]
                share[part, f] = share.get((part, f), 0) + len(gone)
    return {(p, o, s): (*v, share[p, o[s - 1]]) for (p, o, s), v in result.items()}


def test_audit_equals_brute_force(spark, awkward):
    rng = random.Random(3)
    pool = [" ".join(f"w{rng.randrange(300)}" for _ in range(n)) for n in (1, 50, 250, 400)]
    pool += ["WORD " * 250, "a " * 300, "x # y", "é|\u00a0b", " \t\n", "", " ".join(f"w{i}" for i in range(250)) + " $"]
    docs = [(i, rng.choice(pool) + rng.choice(["", "", " tail"]), rng.choice(["a", "b", None, ""])) for i in range(250)]
    docs += [(300, None, "a"), (301, None, "b"), (None, pool[0], "a"), (5, pool[1], "b"), (5, pool[1], "b"), (302, "\x1c\x85 #", "c")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 260, 2)] + [(5, 1, 0), (5, 0, 0), (None, 1, 1), (9999, 1, 1)]
    frame = spark.createDataFrame([(i, t, None, s, 0) for i, t, s in docs], DOCS)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    conditions = filteraudit.text_filters(F.col("text"))
    failed = filteraudit.failure_counts(clashing(frame).withColumn("part", F.lit("x")), known, conditions, F.col("source"))
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filteraudit.interaction_audit(failed, "ABCDE").collect()}
    want = audit_by_brute_force(docs, labels)
    assert got == want and len(got) == 600 * len({s or "" for _, _, s in docs})
    failed = filteraudit.failure_counts(awkward, known, conditions, F.col("source"))
    assert filteraudit.interaction_audit(failed, "ABCDE").where("step = 1 and filter_order = 'ABCDE'").count() == 4
    failed = filteraudit.failure_counts(frame.limit(0), known.limit(0), conditions, F.col("source"))
    assert filteraudit.interaction_audit(failed, "ABCDE").count() == 0


def test_least_squares_gives_shapley_values():
    rng = random.Random(8)
    for n in range(1, 6):
        value = [0] + [rng.randrange(-50, 50) for _ in range((1 << n) - 1)]
        want = [0] * n
        for order in itertools.permutations(range(n)):
            before = 0
            for i in order:
                want[i] += value[before | 1 << i] - value[before]
                before |= 1 << i
        assert [sum(c * v for c, v in zip(row, value)) for row in filteraudit.shapley_coefficients(n)] == want


def test_audit_of_other_filters(spark):
    frame = spark.createDataFrame([(1, "aa", None, "s", 0), (2, "ab", None, "s", 0), (3, None, None, "s", 0)], DOCS)
    known = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    conditions = {"X": F.col("text").contains("a"), "Y": F.col("text").contains("b")}
    failed = filteraudit.failure_counts(frame, known, conditions, F.col("source"), copies=False)
    got = {(r.filter_order, r.step): tuple(r)[3:] for r in filteraudit.interaction_audit(failed, "XY").collect()}
    assert got == {("XY", 1): (1, 2, 0, 1, 1, 0, 3), ("XY", 2): (1, 0, 1, 0, 0, 0, 1), ("YX", 1): (2, 1, 0, 0, 0, 0, 1), ("YX", 2): (1, 1, 1, 1, 1, 0, 3)}


# URLs

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def judged(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [
        (len(h + p), h.count("."), len(p), h + p, v) for v, h, p in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    _, _, _, rule, verdict = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, rule, verdict


def urls(seed: int, n: int) -> list:
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        host = ".".join(rng.choice(["a", "B", "example", "org", "com", "", "de"]) for _ in range(rng.randrange(5)))
        path = "".join(rng.choice(["/", "es", "en", "fr", "de", "1", "é", "?", "#", "://", "\n"]) for _ in range(rng.randrange(7)))
        out.append(rng.choice(["http://", "https://", "://", ":/", ""]) + host + path)
    return out


def test_url_rules_equal_brute_force(spark):
    texts = [*urls(1, 600), None, "", "http://", "http://ORG", "http://a.org/", "http://É.org/x", "http://x.org:80/", "x://y://org/", "http://" + "a." * 500 + "org/" + "x" * 5000]
    texts += ["http://hot.example.org/en/12"] * 50
    pages = spark.createDataFrame([(i % 620, u) for i, u in enumerate(texts)], "page_id long, url string")
    rules = [*RULES, ("block", "a.org", "/"), ("allow", "A.org", "/"), ("block", "", ""), ("allow", "de", ""), ("block", "org", "/es"), ("other", "com", "/")]
    frame = spark.createDataFrame([*rules, (None, "x", "y"), ("block", None, "/")], "verdict string, host string, path string")
    usable = [r for r in rules if r[0] != "other"]
    usable = [(("block" if (h, p) == ("A.org", "/") else v), h.lower(), p) for v, h, p in usable]
    want = sorted((i % 620, *[str(x) for x in judged(u, usable)]) for i, u in enumerate(texts))
    clash = clashing(pages).withColumns({c: F.lit(1) for c in ("host", "path", "rule", "verdict", "labels", "chars", "prefix", "own")})
    for limit in (urlrules.BROADCAST_RULES, 0):
        out = urlrules.judge_urls(clash, frame, broadcast_rules=limit)
        assert sorted((r.page_id, str(r.host), str(r.path), str(r.rule), r.verdict) for r in out.collect()) == want
        assert "labels" in out.columns and out.schema["host"].dataType.simpleString() == "string"


def test_url_rules_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert [tuple(r) for r in urlrules.judge_urls(pages, none, otherwise="block").collect()] == [
        (1, "http://a.org/x", "a.org", "/x", None, "block")
    ]
    rules = spark.createDataFrame(RULES, none.schema)
    assert urlrules.judge_urls(pages.limit(0), rules).count() == 0
