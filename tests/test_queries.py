"""Every registered query equals its SQL twin on the small tables."""
from __future__ import annotations

import pytest

from checks import ORACLES, QUERIES
from checks.compare import compare, duck

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert compare(df.columns, df.collect(), columns, cursor.fetchall()) == ""


def test_repaired_documents_are_the_originals(spark):
    rows = QUERIES["text_repair"](spark, SMALL).collect()
    assert rows and all(r["repaired"] == r["text"] for r in rows)


def test_repair_report_counts_changed_rows(spark):
    got = {r["column_name"]: r["changed_rows"] for r in QUERIES["text_repair_report"](spark, SMALL).collect()}
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    assert got["broken"] == sum(any(ord(ch) > 127 for ch in t) for t in texts) and got["plain"] == 0


def test_duplicate_columns_keep_the_last(spark):
    out = QUERIES["dedupe_columns"](spark, SMALL)
    assert out.columns == ["id", "title", "handle"]
    assert all(r["title"] == r["title"].upper() and r["handle"] == r["id"] for r in out.collect())


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
