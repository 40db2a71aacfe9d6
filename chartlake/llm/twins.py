"""DuckDB SQL for the queries that SQL can express."""
from __future__ import annotations

from chartlake.llm.pii import IBAN_CHARS

SOURCE_MIX = """
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) AS schedule FROM t),
w AS (SELECT *, CASE schedule WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
             source_size * 2.0::DOUBLE AS ceiling FROM r),
b AS (SELECT *, ceiling / weight AS reach,
        coalesce(sum(ceiling) OVER o, 0) AS filled, coalesce(sum(weight) OVER o, 0) AS used,
        sum(weight) OVER () AS all_weight, sum(source_size) OVER () AS total
      FROM w WINDOW o AS (ORDER BY ceiling / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total * 1.5::DOUBLE - filled) / (all_weight - used) AS level FROM b),
f AS (SELECT *, min_by(level, CASE WHEN level <= reach THEN reach END) OVER () AS first FROM l),
g AS (SELECT source, source_size, schedule, least(ceiling, first * weight) AS target FROM f),
p AS (SELECT d.*, g.source_size, g.schedule, g.target,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
c AS (SELECT *, CASE WHEN size > 0 THEN greatest(floor((target - (place + size / 2)) / source_size) + 1, 0) ELSE 0 END
        AS copies, (place + size / 2) / target AS u FROM p)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken,
  CASE WHEN copies > 0 THEN round(CASE schedule
    WHEN 0 THEN (sqrt(greatest(36 + 2 * -2.0::DOUBLE * (u * 5), 0)) - 6) / -2.0::DOUBLE
    WHEN 1 THEN u * 2 / 2
    ELSE (sqrt(greatest(0.25 + 2 * 1.0::DOUBLE * u, 0)) - 0.5) / 1.0::DOUBLE END, 9) END AS position
FROM c
"""

_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 0.9, "mail|contact|write"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 0.6, "ip|host|server|address"),
    ("card", r"[0-9]([\x20-]?[0-9])+", 0.7, "card|visa|credit|payment"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, "phone|call|tel|mobile"),
)
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"


def _fold97(v: str) -> str:
    """Account number as digits, its first four characters last, modulo 97."""
    return (
        f"list_reduce(list_prepend(0, list_transform(string_split(substr(replace({v}, ' ', ''), 5) || substr({v}, 1, 4), ''), "
        "lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), "
        "lambda a, n: (a * CASE WHEN n > 9 THEN 100 ELSE 10 END + n) % 97)"
    )


# Characters of an account number by country code, as the operator has them.
_RUN = "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9])"
_FIXED = "|".join(
    f"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, codes in sorted(IBAN_CHARS.items())
)


_VALID = {
    "email": "TRUE",
    "ip": "len(list_filter(string_split(v, '.'), lambda p: len(ltrim(p, '0')) > 3 OR "
    "CAST('0' || right(ltrim(p, '0'), 3) AS INT) > 255)) = 0",
    "card": f"len({_DIGITS}) BETWEEN 13 AND 19 AND list_sum(list_transform(string_split(reverse({_DIGITS}), ''), "
    "lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INT) ELSE CAST(c AS INT) * 2 - "
    "CASE WHEN CAST(c AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0",
    "phone": f"len({_DIGITS}) BETWEEN 9 AND 15",
}


def _part(number: int, name: str, pattern: str, score: float, words: str) -> str:
    return f"""
SELECT doc_id, row_id, {number} AS k, '{name}' AS kind, s, s + len(v) AS e, {score} +
  CASE WHEN regexp_matches(lower(substr(text, greatest(s - 40, 0) + 1, s - greatest(s - 40, 0))), '{words}')
  THEN 0.1 ELSE 0 END AS score
FROM (SELECT doc_id, row_id, text, unnest(hits) AS v,
        CAST(unnest(list_transform(hits, lambda h, i: list_sum(list_transform(gaps[1:i], lambda g: len(g)))
          + coalesce(list_sum(list_transform(hits[1:i-1], lambda m: len(m))), 0))) AS BIGINT) AS s
      FROM (SELECT doc_id, row_id, text, regexp_extract_all(text, '{pattern}') AS hits,
              regexp_split_to_array(text, '{pattern}') AS gaps FROM d))
WHERE {_VALID[name]}"""


def _confirmed(v: str) -> str:
    return f"CASE WHEN len(replace({v}, ' ', '')) BETWEEN 15 AND 34 THEN {_fold97(v)} = 1 ELSE FALSE END"


# Account numbers, from the left: each start is tried with its country's length, then, if
# no earlier run covers it, with the whole run.
_IBAN = f"""
p AS (SELECT row_id, text, unnest(range(1, length(text) - 13)) AS p FROM d WHERE regexp_matches(text, '[A-Z]{{2}}[0-9]{{2}} ?[A-Z0-9]')),
n AS (SELECT row_id, p - 1 AS s, substr(text, p, 64) AS near FROM p WHERE regexp_matches(substr(text, p, 26), '^{_RUN}{{11}}')),
t AS (SELECT row_id, s, row_number() OVER (PARTITION BY row_id ORDER BY s) AS i,
        regexp_extract(near, '^{_RUN}{{11,30}}') AS run, regexp_extract(near, '^(?:{_FIXED})') AS cut FROM n),
v AS MATERIALIZED (SELECT row_id, s, i, run, cut, {_confirmed("cut")} AS cut_ok, {_confirmed("run")} AS run_ok FROM t),
q(row_id, i, done, run_end, s, e) AS (
  SELECT DISTINCT row_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM v
  UNION ALL
  SELECT row_id, i, CASE WHEN val <> '' THEN s + len(val) ELSE done END,
    CASE WHEN val <> '' THEN s + len(val) WHEN s >= run_end THEN s + len(run) ELSE run_end END, s, s + len(val)
  FROM (SELECT v.row_id, v.i, v.s, v.run, q.done, q.run_end,
          CASE WHEN v.s < q.done THEN '' WHEN v.cut_ok THEN v.cut WHEN v.s >= q.run_end AND v.run_ok THEN v.run ELSE '' END AS val
        FROM q JOIN v ON v.row_id = q.row_id AND v.i = q.i + 1))"""

_IBAN_SPANS = """
SELECT d.doc_id, d.row_id, 4 AS k, 'iban' AS kind, q.s, q.e, 0.8 +
  CASE WHEN regexp_matches(lower(substr(text, greatest(q.s - 40, 0) + 1, q.s - greatest(q.s - 40, 0))), 'iban|account|bank')
  THEN 0.1 ELSE 0 END AS score
FROM q JOIN d USING (row_id) WHERE q.e > q.s"""

PII = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS row_id, coalesce(text, '') AS text FROM documents),
{_IBAN},
s AS ({" UNION ALL ".join(_part(i, *kind) for i, kind in enumerate(_KINDS))} UNION ALL {_IBAN_SPANS}),
g AS (SELECT row_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
        count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (kind <> 'iban') AS base,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS spans,
        count(*) FILTER (score >= 0.8) AS n_confident
      FROM s GROUP BY row_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
  coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_confident, 0) AS n_confident
FROM d LEFT JOIN g USING (row_id)
"""

NEAR_VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
r(node, reached) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.node, l.b FROM r JOIN l ON r.reached = l.a),
c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id,
  e.vec_id = coalesce(c.component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.node = e.vec_id
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 100 = 0),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank,
    vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""

_KEPT = """
v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS INT) AS cluster, x
  FROM (SELECT * FROM v WHERE vec_id IS NOT NULL ORDER BY sha256('2:' || vec_id), x LIMIT 40))"""


def _assigned(n: int) -> str:
    """Nearest centroid of round ``n``; sums of integers below 2**53 are exact in doubles."""
    return f""",
a{n} AS MATERIALIZED (
  SELECT r, min(cluster) AS cluster, any_value(distance) AS distance FROM (
    SELECT r, cluster, distance, min(distance) OVER (PARTITION BY r) AS least FROM (
      SELECT v.r, c.cluster, CAST(list_dot_product(v.x, v.x) - 2 * list_dot_product(v.x, c.x)
        + list_dot_product(c.x, c.x) AS BIGINT) AS distance
      FROM v CROSS JOIN c{n} c)) WHERE distance = least GROUP BY r)"""


def _moved(n: int) -> str:
    return f""",
m{n} AS (
  SELECT cluster, d, CAST(sum(c) AS BIGINT) AS s, count(*) AS n FROM (
    SELECT cluster, unnest(x) AS c, unnest(range(64)) AS d FROM a{n} JOIN v USING (r)) GROUP BY ALL),
c{n + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(g.x, c.x) AS x FROM c{n} c LEFT JOIN (
    SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY d) AS x FROM m{n} GROUP BY cluster) g
  USING (cluster))"""


CENTROIDS = f"""
WITH {_KEPT}{"".join(_assigned(n) + _moved(n) for n in range(5))}{_assigned(5)}
SELECT v.vec_id, a.cluster, a.distance,
  CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c.x, lambda e: CAST(CAST(e AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a5 a JOIN v USING (r) JOIN c5 c ON c.cluster = a.cluster
"""

_SPACELESS = r"[^\x20\x09-\x0D]+"
# The audit by brute force: every order and step is counted from the documents' failures.
FILTER_AUDIT = f"""
WITH RECURSIVE l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '{_SPACELESS}') AS w FROM documents),
f AS (
  SELECT d.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
g AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
p(filter_order, used) AS (
  SELECT '', 0 UNION ALL
  SELECT filter_order || substr('ABCDE', i + 1, 1), used + (1 << i) FROM p, (SELECT unnest(range(5))::INT AS i) WHERE used & (1 << i) = 0),
s AS (
  SELECT filter_order, step, 1 << (strpos('ABCDE', substr(filter_order, step, 1)) - 1) AS bit,
    coalesce(list_sum(list_transform(string_split(substr(filter_order, 1, step - 1), ''),
      lambda c: CASE WHEN c = '' THEN 0 ELSE 1 << (strpos('ABCDE', c) - 1) END)), 0)::INT AS before
  FROM (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM p WHERE used = 31)),
t AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS toxic_lost
  FROM g CROSS JOIN s GROUP BY part, filter_order, step, bit, before)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM t
"""

URL_RULES = """
WITH u AS (
  SELECT row_number() OVER () AS r, page_id,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT r, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT r, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
k(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (
  SELECT p.r, k.host || k.path AS rule, k.verdict,
    row_number() OVER (PARTITION BY p.r ORDER BY length(k.host || k.path) DESC) AS n
  FROM p JOIN k ON (p.host = k.host OR ends_with(p.host, '.' || k.host)) AND starts_with(p.path, k.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON m.r = p.r AND m.n = 1
"""
