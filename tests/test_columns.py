"""Golden values of column functions."""
from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chartlake.functions import coerce, scores, text
from chartlake.functions.comments import LABEL_WEIGHTS, MENTIONS, classify

LABELS = [
    (None, "empty"), ("", "empty"), ("https://a.b/c", "empty"), ("🔥🔥🔥", "emoji_only"), ("!!!", "emoji_only"),
    ("hahahaha", "repeated"), ("ㅋㅋㅋㅋ", "repeated"), ("so so", "repeated"), ("wow", "mention_only"),
    ("first", "mention_only"), ("someuser", "mention_only"), ("ok", "generic_short"), ("nice", "generic_short"),
    ("love it", "generic_short"), ("beat", "too_short"), ("hi there", "too_short"), ("привет", "too_short"),
    ("this is good", "generic_positive"), ("love the chorus melody", "meaningful_music"),
    ("i really love this so", "meaningful_reaction"), ("one two three four five six seven eight", "meaningful_long"),
    ("what is this thing", "generic"), ("a a　a a", "repeated"), ("aab", "mention_only"),
]


def values(df, *names):
    rows = df.collect()
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in rows]


def test_comment_labels(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(LABELS)], "i int, content string")
    got = values(classify(df).orderBy("i"), "quality_label", "quality_weight")
    assert got == [(label, LABEL_WEIGHTS[label]) for _, label in LABELS]


def test_named_mentions(spark):
    df = spark.createDataFrame(
        [("@Jane Doe", [("jane", "Jane Doe")]), ("jane", [("Jane", None)]), ("thanks jane doe", [("jane", "Jane Doe")])],
        f"content string, m {MENTIONS.simpleString()}",
    )
    assert values(classify(df, "content", "m"), "quality_label") == ["mention_only", "mention_only", "generic"]


@pytest.mark.parametrize(
    "value,blank",
    [(None, True), ("", True), (" None ", True), ("NaT", True), ("-", True), ("$5b", True), ("0", False), ("false", False),
     ("$123456789", False), ("　", True), ("undefined", True)],
)
def test_blank(spark, value, blank):
    df = spark.createDataFrame([(value,)], "v string")
    assert values(df.select(coerce.is_blank("v").alias("b"), F.expr(coerce.blank_sql("v")).alias("s")), "b", "s") == [(blank, blank)]


@pytest.mark.parametrize("value,blank", [("{}", True), ('{"a":1}', True), ("[]", True), ("[ ]", True), ('["x"]', False), ("x", False)])
def test_blank_json(spark, value, blank):
    df = spark.createDataFrame([(value,)], "v string")
    sql = F.expr(coerce.blank_sql("v", json_text=True)).alias("s")
    assert values(df.select(coerce.is_blank_json("v").alias("b"), sql), "b", "s") == [(blank, blank)]


def test_numbers(spark):
    df = spark.createDataFrame([(v,) for v in (" 12 ", "1e3", "nan", "x", None, "1d", "-.5", "5.")], "v string")
    assert values(df.select(coerce.to_number("v").alias("n")), "n") == [12.0, 1000.0, 0.0, 0.0, 0.0, 0.0, -0.5, 5.0]
    assert values(df.select(coerce.to_count("v", 9).alias("n")), "n") == [12, 1000, 9, 9, 9, 9, 0, 5]


def test_times(spark):
    raw = ["2026-05-11 16:03:56+00:00", "2026-05-11T16:03:56.123Z", "2026-05-11 18:03:56+02:00", "soon", "", None]
    df = spark.createDataFrame([(v,) for v in raw], "v string").select(coerce.parse_ts("v").alias("t"))
    got = values(df.select(coerce.ts_text("t").alias("a"), coerce.display_time("t").alias("b"), coerce.iso_or_blank("t").alias("c")), "a", "b", "c")
    same = ("2026-05-11 16:03:56.000000+00:00", "2026-05-11 16:03 UTC", "2026-05-11T16:03:56+00:00")
    assert got[0] == same and got[2] == same
    assert got[1] == ("2026-05-11 16:03:56.123000+00:00", "2026-05-11 16:03 UTC", "2026-05-11T16:03:56.123000+00:00")
    assert got[3:] == [(None, "-", "")] * 3


def test_gain(spark):
    df = spark.createDataFrame([(-20.0, -3.0), (-8.0, -3.0), (-30.0, -20.0), (None, -3.0)], "i double, tp double")
    got = values(df.select(scores.normalization_gain("i", "tp").alias("g"), scores.upload_gain("i", "tp").alias("u")), "g", "u")
    assert got == [(2.0, 2.0), (-6.0, -6.0), (6.0, 16.0), (None, None)]
    factor = df.select(F.round(scores.playback_factor(F.lit(60.0)), 3).alias("c"), scores.playback_factor(F.lit(None).cast("double")).alias("n"))
    assert values(factor, "c", "n")[0] == (3.0, 1.0)


def test_community_score(spark):
    df = spark.createDataFrame([(0, 0, 0, "2024-01-31"), (1, 1, 1, "2024-01-01"), (0, 0, 0, "2024-03-01")], "p int, l int, c int, t string")
    df = df.withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = values(df.select(scores.community_score("p", "l", "c", "t", "2024-01-31 00:00:00").alias("s")), "s")
    assert got == [30.0, 5.545177, 30.0]


BROKEN = [
    ("été à la plage", 1), ("Последние новости", 1), ("한국어 노래", 1), ("naïve café", 2), ("plain ascii text", 0),
]


def test_text_repair(spark):
    def damage(t, times):
        for _ in range(times):
            t = t.encode("utf-8").decode("latin1")
        return t

    rows = [(damage(t, n), t) for t, n in BROKEN]
    rows += [(t, t) for t in ("Déjà vu, garçon élève", "ça", "“quoted”", "漢字")]
    df = spark.createDataFrame(rows, "broken string, want string")
    got = values(df.select(text.repair_text("broken").alias("r"), "want"), "r", "want")
    assert [r for r, _ in got] == [w for _, w in got]


def test_text_repair_lossy_is_opt_in(spark):
    df = spark.createDataFrame([("éclat de rire",)], "t string")
    assert values(df.select(text.repair_text("t").alias("r")), "r") == ["éclat de rire"]
    assert values(df.select(text.repair_text("t", lossy=True).alias("r")), "r") == ["clat de rire"]


def test_text_helpers(spark):
    df = spark.createDataFrame([(" @@Ab ", ["x", "-", None, " y "], "a, ,b,c ,d")], "h string, l array<string>, t string")
    got = df.select(
        text.normalize_handle("h").alias("one"), text.tier_handle("h").alias("tier"), text.list_or_text("l").alias("joined"),
        text.style_tags("t", 3).alias("tags"), text.lyrics_bundle(F.lit("a"), F.lit("$5"), F.lit("b")).alias("lyrics"),
        text.normalize_url(F.lit("site.example/x")).alias("url"), text.contains_listed_term(F.lit("B a D"), ["bad"]).alias("listed"),
    ).first()
    assert tuple(got) == ("@Ab", "ab", "x, y", ["a", "b", "c"], "a\n\nb", "https://site.example/x", True)


@pytest.mark.parametrize(
    "url,error",
    [("https://tracks.example.com/song/x", None), ("http://www.tracks.example.com/s/abc?x=1", None), ("", "empty url"),
     ("ftp://tracks.example.com/song/x", "unsupported scheme"), ("https://evil.example.com/song/x", "host not allowed"),
     ("https://tracks.example.com/about", "unsupported path"), ("tracks.example.com/song/x", "unsupported scheme")],
)
def test_links(spark, url, error):
    df = spark.createDataFrame([(url,)], "u string")
    assert values(df.select(text.link_error("u").alias("e")), "e") == [error]
