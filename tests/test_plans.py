"""Plans keep the shape that scales."""
from __future__ import annotations

import pathlib
import re
import uuid

from pyspark.sql import functions as F

from chartlake.functions.text import clean_text
from chartlake.operators import catalog, charts
from chartlake.plans.payload import app_payload
from chartlake.session import shared_folder
from chartlake.sources.driver import AS_OF, Domain

ROOT = pathlib.Path(__file__).resolve().parents[1]
SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_package_never_collects():
    banned = re.compile(r"\.(collect|toPandas|toLocalIterator|localCheckpoint)\(")
    for path in (ROOT / "chartlake").rglob("*.py"):
        if path.parent.name == "llm":  # collects bounded samples of its own
            continue
        assert not banned.search(path.read_text()), path


def test_chart_is_a_distributed_top_k(spark):
    d = Domain(spark, SMALL)
    text = plan(charts.trend_chart(d.songs(), d.song_history(), AS_OF))
    assert "TakeOrderedAndProject(limit=200" in text
    assert "RangePartitioning" not in text and "rangepartitioning" not in text


def test_active_scores_read_recent_history_only(spark):
    d = Domain(spark, SMALL)
    table = f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"
    d.song_history().write.parquet(table)
    stored = spark.read.parquet(table)
    text = plan(charts.active_scores(d.songs(), stored, AS_OF).select("id", "trend_score"))
    assert "GreaterThanOrEqual(checked_at,2024-01-27T00:00)" in text
    assert "flag_count" not in text.split("GreaterThanOrEqual(checked_at")[1].split("ReadSchema")[1].split("\n")[0]


def test_groups_are_limited_before_the_shuffle(spark):
    df = Domain(spark, SMALL).raw("lineitem")
    text = plan(catalog.dedupe_keep(df, ["l_orderkey"], [F.col("l_shipdate").desc()]))
    assert re.search(r"WindowGroupLimit .* row_number\(\), 1, Partial", text)


def test_text_repair_runs_without_python(spark):
    df = Domain(spark, SMALL).raw("documents")
    for lossy in (False, True):
        text = plan(df.select(clean_text("text", lossy=lossy).alias("t")))
        assert "Python" not in text and "Arrow" not in text


def test_history_is_read_once_for_all_lists(spark):
    d = Domain(spark, SMALL)
    table = f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"
    d.song_history().write.parquet(table)
    text = plan(app_payload(d.ranked_songs(), spark.read.parquet(table), AS_OF))
    assert table.rsplit("/", 1)[1] not in text
