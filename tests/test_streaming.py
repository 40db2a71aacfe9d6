"""Streams give the result of the batch form, also over several batches."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chartlake.operators.engagement import liked_pairs
from chartlake.plans import upkeep
from chartlake.session import shared_folder
from chartlake.sources import tables
from chartlake.streaming import jobs

EVENTS = [("s", "user:1"), ("s", "user:1"), ("s", "user:2"), ("t", "user:1"), ("t", "user:3"), ("s", "user:1")]


def folder(spark):
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def test_toggles_over_batches(spark):
    base = folder(spark)
    df = spark.createDataFrame(EVENTS, "song_id string, actor_key string")
    for part in (df.limit(3), df.exceptAll(df.limit(3))):
        part.write.mode("append").parquet(f"{base}/in")
        jobs.like_sink(jobs.file_stream(spark, f"{base}/in", df.schema), f"{base}/log", f"{base}/cp")
    got = sorted(tuple(r) for r in jobs.liked_now(spark, f"{base}/log").collect())
    assert got == sorted(tuple(r) for r in liked_pairs(df).collect())


def test_repeated_batch_replaces_itself(spark):
    base = folder(spark)
    df = spark.createDataFrame([("s", "user:1", 1)], jobs.TOGGLE_LOG)
    for _ in range(2):
        jobs.write_batch(df, base, 7)
    assert [r["toggles"] for r in jobs.read_batches(spark, base, jobs.TOGGLE_LOG).collect()] == [1]


def test_unique_plays_across_batches(spark):
    base = folder(spark)
    rows = [("s", "session-1", 5, "2024-01-01 00:00:00"), ("s", "session-1", 9, "2024-01-02 00:00:00"), ("s", "short", 1, "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "song_id string, session_id string, play_seconds long, counted_at string")
    df = df.withColumn("counted_at", F.col("counted_at").cast("timestamp_ntz"))
    for part in (df.where("play_seconds = 5"), df.where("play_seconds <> 5")):
        part.write.mode("append").parquet(f"{base}/in")
        jobs.play_sink(jobs.file_stream(spark, f"{base}/in", df.schema), f"{base}/out", f"{base}/cp")
        bounded = jobs.file_stream(spark, f"{base}/in", df.schema)
        jobs.play_sink(bounded, f"{base}/out2", f"{base}/cp2", bounded_by="7 days")
    assert [r["play_seconds"] for r in spark.read.parquet(f"{base}/out").collect()] == [5]
    assert spark.read.parquet(f"{base}/out2").count() == 1


def test_repeated_play_batch_changes_nothing(spark):
    """A batch that comes again after a failure, whether before or after its last write."""
    base = folder(spark)
    counters = jobs.Counters(spark, base)
    rows = [("s", f"session-{i % 3}", 5, f"2024-01-01 00:00:0{i}") for i in range(6)] + [("t", "session-1", 5, "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "song_id string, session_id string, play_seconds long, counted_at string")
    counters.count_plays(df.where("session_id = 'session-0'"), "x", 0)
    fresh = jobs.unseen(jobs.valid_plays(df), counters.seen)
    assert fresh.count() == 3
    # The totals of batch 1 were written, the seen pairs not yet.
    counters.add(counters.plays, fresh.groupBy("song_id").agg(F.count(F.lit(1)).alias("play_count")), "x", 1)
    for _ in range(2):
        counters.count_plays(df, "x", 1)
        assert {tuple(r) for r in counters.plays.read().collect()} == {("s", 3), ("t", 1)}
    assert counters.seen.read().count() == 4


def test_like_totals_over_batches_and_upkeep(spark):
    base = folder(spark)
    counters = jobs.Counters(spark, base)
    df = spark.createDataFrame(EVENTS, "song_id string, actor_key string")
    for i, part in enumerate((df.limit(2), df.limit(1), df.where("actor_key <> 'user:1'"), df.where("song_id = 't'"))):
        for _ in range(2):
            counters.count_likes(part, "x", i)
        if i == 2:
            jobs.rewrite_counters(spark, base, over=0, grace=0)
    # s: user:1 twice and once, user:2 once; t: user:3 twice, user:1 once.
    assert {tuple(r) for r in counters.likes.read().collect()} == {("s", 2), ("t", 1)}


def test_batches_read_only_the_buckets_of_their_songs(spark):
    base = folder(spark)
    counters = jobs.Counters(spark, base)
    many = spark.range(2000).selectExpr(
        "concat('song-', id % 500) AS song_id", "concat('session-', id) AS session_id", "1L AS play_seconds",
        "timestamp_ntz '2024-01-01 00:00:00' AS counted_at",
    )
    counters.count_plays(many, "x", 0)
    one = many.where("song_id = 'song-7'").withColumn("session_id", F.concat("session_id", F.lit("-again")))
    touched = counters.seen.touched(one)
    assert len(touched) == 1
    wanted = f"/part={touched[0]}/"
    files = jobs.unseen(one, counters.seen).inputFiles()
    assert all(wanted in f for f in files) and files
    before = counters.plays.listing()[1]["parts"]
    counters.count_plays(one, "x", 1)
    after = counters.plays.listing()[1]["parts"]
    assert sorted(p for p in after if after[p] != before.get(p)) == touched
    assert counters.plays.read().where("song_id = 'song-7'").first()["play_count"] == 8


def test_comments_are_classified_once_over_batches(spark):
    base = folder(spark)
    rows = [("c1", "love the chorus of this song"), ("c2", " "), ("c1", "love the chorus of this song"), ("c3", "nice")]
    df = spark.createDataFrame(rows, "comment_id string, content string")
    for k, part in enumerate((df.where("comment_id <> 'c3'"), df)):
        part.write.parquet(f"{base}/in/{k}")
        stream = spark.readStream.schema(df.schema).parquet(f"{base}/in/*")
        jobs.comment_sink(stream, f"{base}/out", f"{base}/cp", "2024-01-31 00:00:00", ("comment_id", "quality_label"))
    got = sorted(r["comment_id"] for r in spark.read.parquet(f"{base}/out").collect())
    assert got == ["c1", "c3"]


def test_days_are_compacted_once(spark):
    base = folder(spark)
    schema = "id string, checked_at timestamp_ntz, play_count long, upvote_count long, comment_count long"
    rows = [("a", f"2024-01-{d:02d} {h:02d}:00:00", d * 24 + h, 0, 0) for d in (1, 2, 20, 30) for h in (1, 5, 9)] + [("a", None, 1, 0, 0)]
    df = spark.createDataFrame(rows, schema.replace("checked_at timestamp_ntz", "checked_at string"))
    df = df.withColumn("checked_at", F.col("checked_at").cast("timestamp_ntz"))
    table = upkeep.history_table(spark, base, df.schema)
    table.append(df)
    as_of = "2024-01-27 06:00:00"  # the line is the 20th, 06:00
    assert upkeep.compact_days(table, as_of) == ["2024-01-01", "2024-01-02", "2024-01-20"]
    want = upkeep.history_compact(df, as_of)
    assert sorted(map(str, table.read().collect())) == sorted(map(str, want.collect()))
    before = table.listing()[1]["parts"]
    assert upkeep.compact_days(table, as_of) == ["2024-01-20"]  # the day of the line is not marked
    assert upkeep.compact_days(table, "2024-01-28 00:00:00") == ["2024-01-20"]
    assert upkeep.compact_days(table, "2024-01-28 00:00:00") == []
    after = table.listing()[1]["parts"]
    assert sorted(p for p in after if after[p] != before[p]) == ["2024-01-20"]
    late = df.limit(1).withColumn("checked_at", F.lit("2024-01-01 23:00:00").cast("timestamp_ntz"))
    table.append(late)
    assert upkeep.compact_days(table, "2024-01-28 00:00:00") == ["2024-01-01"]
    assert table.read(["2024-01-01"]).first()["checked_at"].hour == 23


def test_upsert_rewrites_only_touched_buckets(spark):
    base = folder(spark)
    rows = spark.range(1000).selectExpr("cast(id AS string) AS id", "id AS n")
    table = tables_of(spark, base, rows.schema)
    upkeep.upsert_table(table, rows)
    before = table.listing()[1]["parts"]
    updates = spark.range(10).selectExpr("cast(id * 100 AS string) AS id", "-1L AS n")  # 1 %
    touched = upkeep.upsert_table(table, updates)
    after = table.listing()[1]["parts"]
    assert 0 < len(touched) <= 10 and sorted(p for p in after if after[p] != before[p]) == touched
    got = {r.id: r.n for r in table.read().collect()}
    assert got == {str(i): (-1 if i % 100 == 0 else i) for i in range(1000)}
    assert len(table.read(touched).inputFiles()) < len(table.read().inputFiles())


def tables_of(spark, base, schema, buckets=64):
    from chartlake.sources.parts import KeyedTable

    return KeyedTable(spark, base, schema, ["id"], buckets)


def test_a_table_keeps_its_number_of_buckets(spark):
    base = folder(spark)
    rows = spark.range(100).selectExpr("cast(id AS string) AS id", "id AS n")
    upkeep.upsert_table(tables_of(spark, base, rows.schema, 4), rows)
    again = tables_of(spark, base, rows.schema, 64)
    upkeep.upsert_table(again, rows.withColumn("n", F.lit(7).cast("long")))
    assert again.buckets == 4 and sorted({r.n for r in again.read().collect()}) == [7] and again.read().count() == 100


def test_a_failed_change_leaves_the_table(spark):
    base = folder(spark)
    rows = spark.range(100).selectExpr("cast(id AS string) AS id", "id AS n")
    table = tables_of(spark, base, rows.schema)
    upkeep.upsert_table(table, rows)
    broken = rows.limit(3).withColumn("n", F.raise_error(F.lit("no")).cast("long"))
    try:
        upkeep.upsert_table(table, broken)
        raise AssertionError("must fail")
    except Exception as error:
        assert "no" in str(error)
    assert table.read().count() == 100
    number, held = table.listing()
    try:
        tables.publish(spark, base, "{}", after=number - 1)
        raise AssertionError("must fail")
    except RuntimeError:
        assert table.listing() == (number, held)


def test_two_versions_remain_and_earlier_readers_finish(spark):
    base = folder(spark)
    spark.range(1).write.parquet(f"{base}/other")  # not a version
    tables.replace_snapshot(spark.range(5), base, grace=0)
    for n in range(6, 10):
        reader = tables.read_snapshot(spark, base)
        tables.replace_snapshot(spark.range(n), base, grace=0)
        assert reader.count() == n - 1
    assert len(tables.glob_names(spark, f"{base}/v-*")) == 2 and tables.read_snapshot(spark, base).count() == 9
    tables.replace_snapshot(spark.range(1), base)  # within the time of grace
    assert len(tables.glob_names(spark, f"{base}/v-*")) == 3
    assert tables.remove_old_versions(spark, base, 0) == 1


def test_growth_state_is_rebuilt_where_the_anchor_changed(spark):
    from chartlake.operators import scoring

    base = folder(spark)
    schema = "id string, checked_at string, play_count long, upvote_count long, comment_count long"
    rows = [(i, f"2024-01-0{d} 0{h}:00:00", 10 * d + h, h, 0) for i in "ab" for d in (1, 2) for h in (2, 5, 8)]
    hist = spark.createDataFrame(rows, schema).withColumn("checked_at", F.col("checked_at").cast("timestamp_ntz"))
    songs = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-01"), ("c", "2024-01-01")], "id string, created_at string")
    songs = songs.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    table = upkeep.growth_table(spark, base, 4)
    upkeep.add_growth(table, songs, hist)
    moved = songs.where("id = 'b'").withColumn("created_at", F.lit("2024-01-02").cast("timestamp_ntz"))
    upkeep.rebuild_growth(table, moved, hist)
    now = songs.where("id <> 'b'").unionByName(moved)
    want = sorted(map(str, scoring.growth_features(now, hist).collect()))
    assert sorted(map(str, scoring.with_growth(now, table.read()).collect())) == want


def test_refresh_in_place_writes_what_it_changes(spark):
    from chartlake.plans.refresh import ChartTables, refresh_tables
    from chartlake.sources.parts import KeyedTable

    base = folder(spark)
    schema = (
        "id string, title string, handle string, created_at timestamp_ntz, last_checked_at timestamp_ntz, next_check_at timestamp_ntz, status string, "
        "fetch_fail_count long, play_count long, upvote_count long, comment_count long, playlist_ref_count boolean, update_tier string, "
        "last_change_at timestamp_ntz, comments_fetch_needed boolean, last_fetch_error string"
    )
    rows = spark.range(200).selectExpr(
        "cast(id AS string) AS id", "concat('song ', id) AS title", "'h' AS handle", "timestamp_ntz '2024-01-01 00:00:00' AS created_at",
        "timestamp_ntz '2024-01-30 00:00:00' AS last_checked_at",
        "IF(id = 42, timestamp_ntz '2024-01-30 12:00:00', timestamp_ntz '2024-02-09 00:00:00') AS next_check_at",
        "'active' AS status", "0L AS fetch_fail_count", "5L AS play_count", "0L AS upvote_count", "0L AS comment_count",
    )
    songs = KeyedTable(spark, f"{base}/songs", spark.createDataFrame([], schema).schema, ["id"], 32)
    upkeep.upsert_table(songs, rows)
    snapshots = spark.createDataFrame([], "checked_at timestamp_ntz, id string, title string, handle string, created_at timestamp_ntz, "
                                          "play_count long, upvote_count long, comment_count long")  # fmt: skip
    tables_ = ChartTables(songs, upkeep.history_table(spark, f"{base}/history", snapshots.schema), upkeep.growth_table(spark, f"{base}/growth", 4))
    feed = spark.createDataFrame([], "id string, record string, page_id long, item_position int")
    page = spark.createDataFrame([("42", '{"id": "42", "play_count": 9}', None)], "id string, record string, error string")
    first = refresh_tables(tables_, feed, page, None, "2024-01-31 00:00:00")
    assert len(first["songs"]) == 32 and first["song_history"] == ["2024-01-31"] and len(first["growth"]) == 1  # tiers of all rows
    again = refresh_tables(tables_, feed, page.limit(0), None, "2024-01-31 01:00:00")
    assert again == {"song_history": [], "growth": [], "songs": []}
    later = refresh_tables(tables_, feed, page, None, "2024-02-05 00:00:00")
    assert len(later["songs"]) == 1 and later["song_history"] == ["2024-02-05"]
    got = {r.id: r for r in songs.read().collect()}
    assert got["42"].play_count == 9 and got["7"].play_count == 5 and len(got) == 200
    assert sorted(str(r.checked_at) for r in tables_.history.read().collect()) == ["2024-01-31 00:00:00", "2024-02-05 00:00:00"]
    assert tables_.growth.read().first()["_n"] == 2


def test_streams_read_a_file_and_a_folder_of_files(spark):
    base = folder(spark)
    df = spark.range(10).selectExpr("cast(id AS string) AS comment_id", "'love the chorus of this song' AS content")
    df.repartition(3).write.parquet(f"{base}/many.parquet")
    part = [n for n in tables.glob_names(spark, f"{base}/many.parquet/part-*")][0]
    for name in ("many.parquet", f"many.parquet/{part}"):
        out = f"{base}/out-{len(name)}"
        jobs.comment_sink(jobs.file_stream(spark, base, df.schema, name), out, f"{out}-cp", "2024-01-31 00:00:00", ("comment_id",), 4)
        assert 0 < spark.read.parquet(out).count() <= 10
    assert spark.read.parquet(f"{base}/out-12").count() == 10


def largest_broadcast(spark, after: int) -> int:
    """Most rows that a query numbered above ``after`` has broadcast."""
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    executions = store.executionsList()
    for i in range(executions.size()):
        number = executions.apply(i).executionId()
        nodes, values = store.planGraph(number).allNodes(), store.executionMetrics(number)
        for node in [nodes.apply(k) for k in range(nodes.size())] if number > after else []:
            metrics = [node.metrics().apply(k) for k in range(node.metrics().size())]
            ids = [m.accumulatorId() for m in metrics if m.name() == "number of output rows"]
            if node.name().startswith("BroadcastExchange") and ids and values.contains(ids[0]):
                most = max(most, int(values.apply(ids[0]).replace(",", "")))
    return most


def test_refresh_in_place_broadcasts_by_measured_size(spark):
    from chartlake.plans.refresh import ChartTables, refresh_tables
    from chartlake.session import GUESSED, MEASURED
    from chartlake.sources.parts import KeyedTable

    base, n = folder(spark), 20_000
    schema = spark.createDataFrame([], "id string, title string, handle string, created_at timestamp_ntz, last_checked_at timestamp_ntz, "
        "next_check_at timestamp_ntz, status string, fetch_fail_count long, play_count long, upvote_count long, comment_count long, "
        "playlist_ref_count boolean, update_tier string, last_change_at timestamp_ntz, comments_fetch_needed boolean, last_fetch_error string").schema  # fmt: skip
    rows = spark.range(n).selectExpr("cast(id AS string) AS id", "timestamp_ntz '2024-01-01 00:00:00' AS last_checked_at", "5L AS play_count")
    songs = KeyedTable(spark, f"{base}/songs", schema, ["id"], 4)
    upkeep.upsert_table(songs, rows.select(*[c if c in rows.columns else F.lit(None).alias(c) for c in schema.names]))
    snapshots = spark.createDataFrame([], "checked_at timestamp_ntz, id string, created_at timestamp_ntz, play_count long, upvote_count long, comment_count long")
    tables_ = ChartTables(songs, upkeep.history_table(spark, f"{base}/history", snapshots.schema))
    feed = spark.createDataFrame([], "id string, record string, page_id long, item_position int")
    page = songs.read().selectExpr("id", "concat('{\"play_count\": 9, \"id\": \"', id, '\"}') AS record", "CAST(null AS string) AS error")
    limit, set_before = 64 * 1024, spark.conf.get(GUESSED, None)
    spark.conf.set(GUESSED, str(limit))
    try:
        executions = spark._jsparkSession.sharedState().statusStore().executionsList()
        after = max([executions.apply(i).executionId() for i in range(executions.size())], default=-1)
        refresh_tables(tables_, feed, page, None, "2024-01-31 00:00:00")
        assert (spark.conf.get(GUESSED), spark.conf.get(MEASURED, None)) == (str(limit), None)
    finally:
        spark.conf.unset(GUESSED) if set_before is None else spark.conf.set(GUESSED, set_before)
    assert songs.read().where("play_count = 9").count() == n
    assert largest_broadcast(spark, after) <= limit / 24  # bytes of a row with an id


def test_stored_tables_are_loaded_by_measured_size(spark):
    from chartlake.session import GUESSED
    from checks import QUERIES

    base, n = folder(spark), 20_000
    shapes = {
        "part": (n, "id AS p_partkey", "'name' AS p_name", "'brand' AS p_brand", "'type' AS p_type", "5 AS p_size", "1.0D AS p_retailprice"),
        "events": (300, "id AS event_id", "timestamp_ntz '2024-01-03 00:00:00' + make_dt_interval(0, id) AS ts", "id % 20 AS user_id",
                   "element_at(array('view', 'click', 'error'), cast(id % 3 + 1 AS int)) AS event_type", "1.0D AS value", "'{}' AS props"),
        "lineitem": (20, "id AS l_suppkey", "1 AS l_linenumber"),
    }
    for name, (rows, *columns) in shapes.items():
        spark.range(0, rows, 1, 1).selectExpr(*columns).write.parquet(f"{base}/{name}.parquet")
    limit, set_before = 256 * 1024, spark.conf.get(GUESSED, None)
    spark.conf.set(GUESSED, str(limit))
    try:
        executions = spark._jsparkSession.sharedState().statusStore().executionsList()
        after = max([executions.apply(i).executionId() for i in range(executions.size())], default=-1)
        out = QUERIES["refresh_tables"](spark, base)
        assert out.where("id LIKE 'new-%'").count() == n
    finally:
        spark.conf.unset(GUESSED) if set_before is None else spark.conf.set(GUESSED, set_before)
    assert largest_broadcast(spark, after) <= limit / 16  # bytes of a row with a number
