"""Run registered queries and their SQL twins side by side and compare them.

Usage: ``python -m checks.compare [folder] [name ...]``
"""
from __future__ import annotations

import glob
import os
import sys
import time
from collections import Counter

import duckdb

DEFAULT_FOLDER = "/root/testdata/sf0.01"


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    """Typed text of a value, so that 1, 1.0 and "1" differ."""
    if v is None or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, bool):
        return f"b:{v}"
    if isinstance(v, int):
        return f"i:{v}"
    if isinstance(v, float):
        return f"f:{round(v, 9) + 0.0!r}"
    return f"{type(v).__name__}:{v}"


def compare(columns, got, want_columns, want) -> str:
    """Empty text when equal, otherwise the first difference."""
    if sorted(columns) != sorted(want_columns):
        return f"columns {sorted(columns)} != {sorted(want_columns)}"

    def rows(names, data):
        places = [names.index(n) for n in sorted(names)]
        return Counter(tuple(_cell(r[i]) for i in places) for r in data)

    a, b = rows(list(columns), got), rows(list(want_columns), want)
    if a == b:
        return ""
    only_a, only_b = list((a - b))[:2], list((b - a))[:2]
    return f"rows {len(got)} vs {len(want)}; spark only {str(only_a)[:600]}; sql only {str(only_b)[:600]}"


def run(spark, folder: str, names=None) -> dict[str, str]:
    from checks import ORACLES, QUERIES

    con = duck(folder)
    result = {}
    for name in names or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            got = df.collect()
            spent = time.time() - start
            if name in ORACLES:
                cursor = con.execute(ORACLES[name])
                kinds = [(c[0], str(c[1])) for c in cursor.description]
                wide = [c for c in kinds if "HUGEINT" in c[1] or "DECIMAL" in c[1]]
                result[name] = compare(df.columns, got, [c[0] for c in kinds], cursor.fetchall())
                if wide and not result[name]:
                    result[name] = f"wide SQL types {wide}"
            else:
                result[name] = "" if len(got) else "no rows"
        except Exception as exc:  # reported, not hidden
            spent = time.time() - start
            result[name] = f"{type(exc).__name__}: {str(exc)[:700]}"
        print(f"{'ok  ' if not result[name] else 'FAIL'} {name} {spent:.1f}s {result[name]}", flush=True)
    return result


if __name__ == "__main__":
    from chartlake import build_session
    from chartlake.session import drop_stages

    args = sys.argv[1:]
    folder = args[0] if args and os.path.isdir(args[0]) else DEFAULT_FOLDER
    chosen = [a for a in args if a != folder]
    session = build_session("compare", "8")
    outcome = run(session, folder, chosen)
    drop_stages(session)
    bad = [n for n, text in outcome.items() if text]
    print(f"{len(outcome) - len(bad)} of {len(outcome)} equal; differing: {bad}")
    sys.exit(1 if bad else 0)
