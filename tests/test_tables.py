"""Golden values and invariants of table operators."""
from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from chartlake.config import TierConfig
from chartlake.operators import archive, catalog, charts, engagement, playlists, quality, scoring
from chartlake.operators.ordinal import global_ordinal, ordinals_of, running_totals
from chartlake.operators.skew import hot_keys, salted_join
from chartlake.plans.search import SearchTable
from chartlake.session import shared_folder
from chartlake.sources import feeds, tables

NOW = "2024-01-31 00:00:00"


def frame(spark, rows, schema, times=()):
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({t: F.col(t).cast("timestamp_ntz") for t in times}) if times else df


def history(spark, rows):
    schema = "id string, checked_at string, play_count long, upvote_count long, comment_count long"
    return frame(spark, rows, schema, ("checked_at",))


def test_growth(spark):
    songs = frame(
        spark, [("a", "2024-01-01"), ("b", "2024-01-01"), ("c", "2024-01-01"), ("d", None), ("e", "2024-01-01")],
        "id string, created_at string", ("created_at",),
    )
    rows = [("a", f"2024-01-01 0{h}:00:00", p, 0, 0) for h, p in ((2, 10), (3, 20), (5, 26))]
    rows += [("b", "2024-01-01 04:00:00", 9, 9, 9), ("b", "2024-01-01 06:00:00", 5, 11, 9)]
    rows += [("c", "2024-01-01 04:00:00", 9, 0, 0), ("d", "2024-01-01 04:00:00", 1, 0, 0), ("d", "2024-01-01 05:00:00", 3, 0, 0)]
    out = {r["id"]: r for r in scoring.growth_features(songs, history(spark, rows)).collect()}
    assert (out["a"]["play_velocity_per_hour"], out["a"]["play_delta_window"]) == (3.0, 9.0)
    assert (out["b"]["play_velocity_per_hour"], out["b"]["upvote_velocity_per_hour"]) == (0.0, 1.0)
    assert [out[k]["play_delta_window"] for k in "cde"] == [0.0, 0.0, 0.0]


def test_movement(spark):
    ranked = spark.createDataFrame([(2, 5.0), (5, 2.0), (4, 4.0), (1, None)], "rank int, previous_rank double")
    out = charts.movement(ranked, F.lit(True)).collect()
    assert [(r["rank_change"], r["rank_status"]) for r in out] == [(3.0, "up"), (-3.0, "down"), (0.0, "same"), (None, "new")]
    none = charts.movement(ranked.withColumn("previous_rank", F.lit(None).cast("double")), F.lit(False)).collect()
    assert {(r["rank_change"], r["rank_status"]) for r in none} == {(None, "")}


def test_tiers(spark):
    old, young = "2024-01-01", "2024-01-30"
    rows = [
        ("private", "x", young, "private", 0, None), ("fails", "x", young, "", 10, None), ("nocreated", "x", None, "", 0, None),
        ("young3", "x", young, "", 3, None), ("listed", "x", old, "", 0, None), ("crew", "@Foo", old, "", 0, None),
        ("crew3", "foo", old, "", 3, None), ("cold", "x", old, "", 0, None), ("planned", "x", old, "", 0, "2024-02-05"),
    ]
    db = frame(spark, rows, "id string, handle string, created_at string, status string, fetch_fail_count long, next_check_at string",
               ("created_at", "next_check_at")).withColumn("last_checked_at", F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))
    refs = spark.createDataFrame([("listed",), ("listed",)], "song_id string")
    cfg = TierConfig(warm_handles=("@FOO",))
    out = catalog.update_tiers(db, refs, NOW, cfg)
    hours = (F.timestamp_diff("HOUR", F.lit(NOW).cast("timestamp_ntz"), F.col("next_check_at"))).alias("h")
    got = {r["id"]: (r["update_tier"], r["h"], r["status"]) for r in out.select("id", "update_tier", hours, "status").collect()}
    assert got == {
        "private": ("frozen", 168, "private"), "fails": ("frozen", 168, "active"), "nocreated": ("hot", 0, "active"),
        "young3": ("hot", 24, "active"), "listed": ("playlist", 24, "active"), "crew": ("warm", 6, "active"),
        "crew3": ("warm", 24, "active"), "cold": ("cold", 72, "active"), "planned": ("cold", 120, "active"),
    }
    due = {r["id"] for r in catalog.due_items(db, refs, NOW, cfg).collect()}
    assert due == {"nocreated", "young3", "crew", "crew3"}


def test_compaction(spark):
    rows = [("a", f"2024-01-21 0{h}:00:00", h, 0, 0) for h in (1, 2, 3)]
    rows += [("a", f"2024-01-30 0{h}:00:00", h, 0, 0) for h in (1, 2, 3)] + [("a", None, 9, 0, 0)]
    once = catalog.history_compact(history(spark, rows), NOW)
    assert sorted(r["play_count"] for r in once.collect()) == [1, 2, 3, 3, 9]
    assert catalog.history_compact(once, NOW).count() == once.count()


def test_playlist_positions(spark):
    lists = spark.createDataFrame([("p", ["a", "", "b", "a"])], "playlist_id string, song_ids array<string>")
    got = {base: {r["song_id"]: r["position"] for r in playlists.playlist_positions(lists, base).collect()} for base in (0, 1)}
    assert got == {0: {"a": 0, "b": 2}, 1: {"a": 1, "b": 2}}


def test_quality_summary(spark):
    rows = [("s", "meaningful_music", 1.0), ("s", "generic", 0.45), ("s", "generic", 0.45)]
    labelled = spark.createDataFrame(rows, "song_id string, quality_label string, quality_weight double")
    counts = spark.createDataFrame([("s", 10), ("none", 7), ("zero", 0)], "id string, comment_count long")
    out = {r["id"]: r for r in quality.quality_summary(labelled, counts).collect()}
    s = out["s"]
    assert (s["weighted_quality_sum"], s["comment_quality_ratio"], s["adjusted_comment_count"]) == (1.9, 0.6333, 6.33)
    assert s["comment_quality_summary"] == "generic:2, meaningful_music:1"
    assert (out["none"]["comment_quality_ratio"], out["none"]["adjusted_comment_count"]) == (1.0, 7.0)
    zero = {r["id"]: r for r in quality.quality_summary(labelled, counts, "zero").collect()}
    assert (zero["none"]["comment_quality_ratio"], zero["none"]["adjusted_comment_count"]) == (0.0, 0.0)
    assert zero["zero"]["comment_quality_ratio"] == 1.0


def test_blank_analysis_time_counts_as_unanalyzed(spark):
    df = spark.createDataFrame([("a", ""), ("b", None), ("c", "2024-01-01")], "comment_id string, analyzed_at string")
    assert {r["comment_id"] for r in quality.unanalyzed(df).collect()} == {"a", "b"}


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "id string, v int")
    once = catalog.upsert_by_key(base, new, ["id"])
    twice = catalog.upsert_by_key(once, new, ["id"])
    assert sorted(once.collect()) == sorted(twice.collect()) == [("a", 1), ("b", 3), ("c", 4)]


def test_upsert_keeps_keys_unique(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 3), ("b", 5), ("c", 4), ("b", 4)], "id string, v int")
    assert sorted(catalog.upsert_by_key(base, new, ["id"], [F.col("v").desc()]).collect()) == [("a", 1), ("b", 5), ("c", 4)]
    assert catalog.upsert_by_key(base, new, ["id"]).count() == 3


def test_equal_snapshot_times_use_one_row(spark):
    songs = frame(spark, [("a", "2024-01-01")], "id string, created_at string", ("created_at",))
    rows = [("a", "2024-01-01 04:00:00", 5, 9, 0), ("a", "2024-01-01 04:00:00", 6, 1, 0)]
    rows += [("a", "2024-01-01 06:00:00", 20, 2, 0), ("a", "2024-01-01 06:00:00", 8, 30, 0)]
    out = {tuple(r) for n in range(3) for r in scoring.growth_features(songs, history(spark, rows[n:] + rows[:n]))
           .select("play_velocity_per_hour", "upvote_velocity_per_hour").collect()}
    assert out == {(1.0, 14.5)}
    day = [("a", "2024-01-10 04:00:00", v, 0, 0) for v in (3, 7, 5)]
    assert catalog.history_compact(history(spark, day), NOW).first()["play_count"] == 7
    point = charts.history_points(history(spark, day), songs, 1).first()["points"][0]
    assert point["play_count"] == 7


def test_null_keys_stay_out_of_salted_joins(spark):
    big = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("k"), "id")
    small = spark.createDataFrame([("1", "x"), (None, "y")], "k string, label string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = big.join(small, "k", how)
        got = salted_join(big, small, ["k"], how, hot_rows=100)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())), how


def test_reader_between_two_versions(spark):
    table = f"{shared_folder(spark)}/versions-{spark.sparkContext.startTime}"
    tables.replace_snapshot(spark.range(3), table)
    tables.replace_snapshot(spark.range(5), table)
    assert len(tables.pointers(spark, table)) == 2 and tables.read_snapshot(spark, table).count() == 5
    # A version that is written but not yet published changes nothing.
    spark.range(9).write.parquet(f"{table}/v-unpublished")
    assert tables.read_snapshot(spark, table).count() == 5
    fs, path = tables._filesystem(spark, table), tables._path(spark, tables._pointer(table, 2))
    fs.delete(path, False)
    assert tables.read_snapshot(spark, table).count() == 3


def test_long_comments_are_tested_whole(spark):
    songs = spark.createDataFrame([("s", True)], "id string, comments_enabled boolean")
    rows = [("s", "a fine comment"), ("s", "x" * 600 + " bad word"), ("s", "good " * 90 + "badword"), ("s", "x"), (None, "hello there")]
    out = engagement.admissible_comments(spark.createDataFrame(rows, "song_id string, body string"), songs, ("badword",)).collect()
    got = {r["body"][-8:]: (r["reason"], r["accepted"]) for r in out}
    assert got == {
        " comment": ("", True), "bad word": ("too long", False), " badword": ("listed term", False), "x": ("too short", False),
        "lo there": ("comments disabled", False),
    }


def test_saved_playlist_replaces_items(spark):
    lists = spark.createDataFrame([("p", "me", "old", "public", "active")], "id string, owner_user_id string, name string, visibility string, status string")
    lists = lists.withColumn("updated_at", F.lit(NOW).cast("timestamp_ntz"))
    items = spark.createDataFrame([("p", "z", 0), ("q", "y", 0)], "playlist_id string, song_id string, position int")
    rows = [(1, "p", "you", "n", ["a"]), (2, "p", "me", " ", ["b", " ", "a", "b"]), (3, "new", "me", "mine", None), (4, "x", "", "n", ["a"])]
    requests = spark.createDataFrame(rows, "request_id int, playlist_id string, owner_user_id string, name string, song_ids array<string>")
    out = playlists.playlist_save(lists, items, requests, NOW)
    assert sorted((r.request_id, r.ok, r.name, r.song_count) for r in out["results"].collect()) == [
        (1, False, "n", 0), (2, True, "My Playlist", 2), (3, True, "mine", 0), (4, False, "n", 0),
    ]
    assert sorted((r.playlist_id, r.song_id, r.position) for r in out["items"].collect()) == [("p", "a", 2), ("p", "b", 0), ("q", "y", 0)]
    assert sorted(r.id for r in out["playlists"].collect()) == ["new", "p"]
    ids = [r.song_id for r in playlists.ordered_song_ids(out["playlists"], out["items"], "p", "me").collect()]
    assert ids == ["b", "a"] and playlists.ordered_song_ids(out["playlists"], out["items"], "p", "you").count() == 0


def test_dedupe_columns_keeps_last(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("a", "b", "a")
    out = catalog.dedupe_columns(df)
    assert out.columns == ["b", "a"] and out.first() == (2, 3)


def test_archive_best_values(spark):
    rows = [("a", "2024-01-01 00:00:00", 5, 1.0), ("a", "2024-01-02 00:00:00", 2, 9.0), ("a", "2024-01-03 00:00:00", 2, 9.0)]
    ranks = frame(spark, rows, "id string, captured_at string, rank long, trend_score double", ("captured_at",))
    r = archive.rank_history_summary(ranks).first()
    assert (r["best_rank_history"], str(r["best_rank_at"]), str(r["best_score_at_history"])) == (2, "2024-01-02 00:00:00", "2024-01-02 00:00:00")
    assert (r["top10_count"], r["chart_in_count"]) == (3, 3)


def hot_frame(spark, n=30000):
    hot = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 500).cast("string"))
    return spark.range(0, n, 1, 8).select(hot.alias("k"), F.col("id").alias("v"), (F.col("id") % 7).alias("w"))


def test_salted_join_equals_join(spark):
    big = hot_frame(spark)
    small = big.select("k").distinct().where(F.col("k") != "7").withColumn("label", F.upper("k"))
    assert [r["k"] for r in hot_keys(big, ["k"], 1000).collect()] == ["hot"]
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = big.join(small, "k", how).groupBy("k").agg(F.count("*"), F.sum("v"))
        got = salted_join(big, small, ["k"], how, hot_rows=1000).groupBy("k").agg(F.count("*"), F.sum("v"))
        assert sorted(got.collect()) == sorted(want.collect()), how


def test_running_totals_equal_window(spark):
    df = hot_frame(spark)
    w = Window.partitionBy("k").orderBy("v")
    want = df.withColumn("total", F.sum("w").over(w)).select("k", "v", "total")
    got = running_totals(df, ["k"], F.floor(F.col("v") / 100), [F.col("v")], {"total": F.col("w")}).select("k", "v", "total")
    assert sorted(got.collect()) == sorted(want.collect())


def test_global_ordinal_equals_row_number(spark):
    df = hot_frame(spark)
    order = [F.col("w").desc(), F.col("k").asc(), F.col("v").asc()]
    want = df.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    got = global_ordinal(df, order, "rank", partitions=7)
    assert sorted(got.select("v", "rank").collect()) == sorted(want.select("v", "rank").collect())


def test_snapshot_replace_reads_its_own_table(spark):
    table = f"{shared_folder(spark)}/replace-test"
    tables.replace_snapshot(spark.range(3), table)
    tables.replace_snapshot(tables.read_snapshot(spark, table).select((F.col("id") * 2).alias("id")), table)
    assert sorted(r["id"] for r in tables.read_snapshot(spark, table).collect()) == [0, 2, 4]
    assert tables.read_snapshot(spark, f"{table}-none", spark.range(1).schema).count() == 0


def test_csv_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,text\r\n1,"two\nlines, ""quoted"""\r\n2,\r\n', encoding="utf-8-sig")
    out = tables.read_csv(spark, str(path), ("id", "text", "extra")).collect()
    assert sorted(tuple(r) for r in out) == [("1", 'two\nlines, "quoted"', ""), ("2", "", "")]


def test_record_kinds(spark):
    record = """{"id":"x","title":["a"],"display_tags":{"a":1},"prompt":"[Verse] {x}","lyric":["no"],
      "metadata":{"title":"M","tags":["t1","-","t2"],"contest_ids":[]},"play_count":"12","like_count":3,"explicit":true,
      "image_url":"$5","clip":{"image_url":"i"}}"""
    df = spark.createDataFrame([("x", record), ("y", "not json")], "id string, record string")
    rows = {r["id"]: r for r in feeds.flatten_records(df, None, NOW).collect()}
    x = rows["x"]
    assert (x["title"], x["display_tags"], x["prompt"], x["lyrics"]) == ("M", "t1, t2", "[Verse] {x}", "[Verse] {x}")
    assert (x["play_count"], x["upvote_count"], x["explicit"], x["image_url"], x["contest_ids"]) == (12, 3, True, "i", None)
    assert (rows["y"]["title"], rows["y"]["play_count"]) == ("Untitled", 0)


def test_embedded_object(spark):
    bodies = ['x "clip":{"a":"}{\\"","b":{"c":1}} } tail', 'no marker {"a":1}', 'bad "clip": {"a":', '"clip": none']
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    got = [r[0] for r in df.select(feeds.embedded_object("body")).collect()]
    assert got == ['{"a":"}{\\"","b":{"c":1}}', None, None, None]


def test_comment_pages_cap_spans_pages(spark):
    page = '{"results":[{"id":"a","content":" x ","replies":[{"id":"r","content":"y","num_replies":4}]},{"id":"b","content":""}]}'
    df = spark.createDataFrame([("s", 0, page), ("s", 1, page.replace('"a"', '"c"')), ("s", 2, page)], "song_id string, page_no int, body string")
    got = sorted((r["comment_id"], r["content"], r["is_reply"], r["num_replies"]) for r in feeds.flatten_comments(df, cap=3).collect())
    assert got == [("a", "x", False, 0), ("c", "x", False, 0), ("r", "y", True, 0), ("r", "y", True, 0)]


def test_comment_pages_without_a_limit(spark):
    pages = [("s", n, '{"results":[' + ",".join(f'{{"id":"{n}-{i}","content":"c"}}' for i in range(26)) + "]}") for n in range(5)]
    df = spark.createDataFrame(pages, "song_id string, page_no int, body string")
    assert feeds.flatten_comments(df).count() == 130
    assert feeds.flatten_comments(df, cap=30).count() == 30 and feeds.flatten_comments(df, max_pages=2).count() == 52


def test_like_parity(spark):
    rows = [("s", "user:1"), ("s", "user:1"), ("s", "user:2"), ("s", "u"), ("t", "user:1")]
    df = spark.createDataFrame(rows, "song_id string, actor_key string")
    assert sorted(tuple(r) for r in engagement.liked_pairs(df).collect()) == [("s", "user:2"), ("t", "user:1")]


def test_outliers_need_spread(spark):
    same = spark.createDataFrame([("a", 5, 5, 5), ("b", 5, 5, 5)], "id string, play_count long, upvote_count long, comment_count long")
    assert {r["is_outlier"] for r in scoring.outlier_flags(same, 1.0).collect()} == {False}
    spread = same.unionByName(spark.createDataFrame([("c", 4000000, 5, 5)], same.schema))
    row = scoring.outlier_flags(spread, 1.0).where("id = 'c'").first()
    assert row["outlier_reasons"] == "play 4,000,000 / z=1.41" and row["is_outlier"]


def test_ranks_of_some_rows_equal_ranks_of_all(spark):
    rows = spark.range(3000).selectExpr("id", "IF(id % 11 = 0, NULL, (id * 7919) % 97 / 4.0) AS score", "id % 3 = 0 AS old")
    rows = rows.withColumn("score", F.when(F.col("id") % 2 == 0, 3.25).otherwise(F.col("score")))  # half of the rows tie
    order = [F.col("score").desc_nulls_last(), F.col("id").asc()]
    want = {r["id"]: r["n"] for r in rows.select("id", F.row_number().over(Window.orderBy(*order)).alias("n")).collect()}
    for hot in (10**6, 50):
        some = ordinals_of(rows, F.col("old"), order, F.floor(F.col("score")), "n", hot_rows=hot).collect()
        assert {r["id"]: r["n"] for r in some} == {i: n for i, n in want.items() if i % 3 == 0}
        few = ordinals_of(rows, F.col("id") == 2997, order, F.floor(F.col("score")), "n", hot_rows=hot).collect()
        assert [(r["id"], r["n"]) for r in few] == [(2997, want[2997])]


def test_saving_a_playlist_keeps_its_other_columns(spark):
    lists = spark.createDataFrame(
        [("p", "me", "old", "public", "active", "2024-01-01", "note"), ("q", "you", "q", "private", "active", "2024-01-01", "n")],
        "id string, owner_user_id string, name string, visibility string, status string, updated_at string, extra string",
    ).withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))
    items = spark.createDataFrame([("p", "x", 0)], "playlist_id string, song_id string, position int")
    requests = spark.createDataFrame(
        [(1, "p", "me", "one", ["a", "b", "c"]), (2, "p", "me", "two", ["d"]), (3, "p", "you", "mine", ["e"]), (4, "n", "me", " ", [])],
        "request_id int, playlist_id string, owner_user_id string, name string, song_ids array<string>",
    )
    out = playlists.playlist_save(lists, items, requests, NOW)
    got = {r.id: r for r in out["playlists"].collect()}
    assert (got["p"].name, got["p"].visibility, got["p"].extra, str(got["p"].updated_at)) == ("two", "public", "note", NOW)
    assert (got["n"].name, got["n"].visibility, got["n"].extra) == ("My Playlist", "private", None) and got["q"].extra == "n"
    results = {r.request_id: (r.ok, r.message, r.song_count) for r in out["results"].collect()}
    assert results == {1: (False, "superseded", 0), 2: (True, "", 1), 3: (False, "playlist not found", 0), 4: (True, "", 0)}
    assert [r.song_id for r in out["items"].collect()] == ["d"]


def test_playlist_functions_in_sql(spark):
    lists = spark.createDataFrame(
        [("p", "me", "one", "active", 1), ("q", "me", "two", "deleted", 2), ("r", "me", "three", "active", 3)],
        "id string, owner_user_id string, name string, status string, updated_at int",
    )
    items = spark.createDataFrame(
        [("p", "b", 1, 5), ("p", "a", 1, 4), ("p", "c", None, 9), ("q", "z", 0, 0)], "playlist_id string, song_id string, position int, added_at int"
    )
    playlists.register_playlist_functions(lists, items)
    rows = spark.sql("SELECT * FROM list_playlists('me') ORDER BY updated_at DESC").collect()
    assert [(r.id, r.song_count) for r in rows] == [("r", 0), ("p", 3)]
    songs = spark.sql("SELECT song_id FROM playlist_song_ids('me', 'p') ORDER BY position, added_at, song_id").collect()
    assert [r.song_id for r in songs] == ["c", "a", "b"]
    assert spark.sql("SELECT * FROM playlist_song_ids('you', 'p')").count() == 0
    assert spark.sql("SELECT * FROM playlist_song_ids('me', 'q')").count() == 0


def test_natural_order(spark):
    want = ["", "1", "02", "9", "10", "가2", "가10", "a9", "Á10", "a010b", "a11", "b", "É2", "e10"]  # Korean has its letters first
    rows = spark.createDataFrame([(w, i) for i, w in enumerate(want)][::-1], "t string, rank int")
    assert [r.t for r in charts.view_sort(rows, "t", False, 100, "ko_CI_AI").orderBy("view_position").collect()] == want
    assert [r.t for r in charts.view_sort(rows, "t", True, 100, "ko_CI_AI").orderBy("view_position").collect()] == want[::-1]


def test_search_reads_only_candidates(spark):
    rows = spark.range(4000).selectExpr("cast(id AS string) AS id", "IF(id % 1000 = 7, concat('the Gear ', id), concat('song ', id)) AS title")
    table = SearchTable(spark, f"{shared_folder(spark)}/search-{uuid.uuid4().hex}", rows.schema, ("title",))
    table.upsert(rows)
    for query in (" gEAR ", "ar 1007", "g", "", "no such thing", "the gear 7 "):
        got = sorted(r.id for r in table.search(query).collect())
        assert got == sorted(r.id for r in charts.search_songs(rows, query, ("title",)).collect()), query
    files = len(table.search("gear").inputFiles())
    assert 0 < files <= 4 + 1 < len(table.items.read().inputFiles())  # the ids and the parts of four items
    table.upsert(rows.where("id = '7'").withColumn("title", F.lit("renamed")))
    assert sorted(r.id for r in table.search("gear").collect()) == ["1007", "2007", "3007"]
    assert [r.id for r in table.search("Renam").collect()] == ["7"]
