"""Column functions over whole given tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from chartlake.functions import coerce, comments, scores, text
from checks.registry import check

LINE_KEYS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
LINE_SQL = ", ".join(LINE_KEYS)

# Texts that stress the number and blank gates, chosen by the order priority.
RAW_TEXT_SQL = """CASE o_orderpriority WHEN '1-URGENT' THEN ' ' || o_totalprice::VARCHAR || ' ' WHEN '2-HIGH' THEN 'nan'
    WHEN '3-MEDIUM' THEN o_orderkey::VARCHAR || 'x' WHEN '5-LOW' THEN '-' || o_custkey::VARCHAR ELSE '' END"""


def raw_text(d):
    kind = F.col("o_orderpriority")
    raw = (
        F.when(kind == "1-URGENT", F.concat(F.lit(" "), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" ")))
        .when(kind == "2-HIGH", "nan")
        .when(kind == "3-MEDIUM", F.concat(F.col("o_orderkey").cast("string"), F.lit("x")))
        .when(kind == "5-LOW", F.concat(F.lit("-"), F.col("o_custkey").cast("string")))
        .otherwise("")
    )
    return d.raw("orders").withColumn("raw", raw)


@check(
    "num_coerce",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN o_totalprice WHEN '5-LOW' THEN -o_custkey ELSE 0 END::DOUBLE
         AS number, CASE o_orderpriority WHEN '1-URGENT' THEN trunc(o_totalprice) WHEN '5-LOW' THEN -o_custkey ELSE 7 END::BIGINT
         AS whole, CASE o_orderpriority WHEN '1-URGENT' THEN o_totalprice WHEN '5-LOW' THEN -o_custkey END::DOUBLE AS or_null
       FROM orders""",
)
def num_coerce(d):
    return raw_text(d).select(
        "o_orderkey",
        (coerce.to_number("raw") + 0.0).alias("number"),
        coerce.to_count("raw", 7).alias("whole"),
        (coerce.to_number("raw", None) + 0.0).alias("or_null"),
    )


def iso_texts(d):
    """Three text forms of the event time and one broken one."""
    kind = F.col("event_type")
    forms = (
        F.when(kind == "view", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(kind == "click", F.date_format("ts", "yyyy-MM-dd HH:mm:ss'+00:00'"))
        .when(kind == "purchase", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .when(kind == "signup", F.lit("NaT"))
        .otherwise(F.concat(F.lit("at "), F.col("event_id").cast("string")))
    )
    return d.raw("events").withColumn("raw", forms)


PARSED_SQL = """CASE event_type WHEN 'view' THEN ts WHEN 'click' THEN date_trunc('second', ts) WHEN 'purchase' THEN ts END"""


@check("ts_parse_mixed", f"SELECT event_id, {PARSED_SQL} AS parsed FROM events")
def ts_parse_mixed(d):
    return iso_texts(d).select("event_id", coerce.parse_ts("raw").alias("parsed"))


@check("ts_serialize", f"SELECT event_id, strftime({PARSED_SQL}, '%Y-%m-%d %H:%M:%S.%f') || '+00:00' AS canonical FROM events")
def ts_serialize(d):
    return iso_texts(d).select("event_id", coerce.ts_text(coerce.parse_ts("raw")).alias("canonical"))


@check(
    "time_display",
    f"""SELECT event_id, coalesce(strftime(p, '%Y-%m-%d %H:%M UTC'), '-') AS shown,
          coalesce(CASE WHEN event_type = 'click' THEN strftime(p, '%Y-%m-%dT%H:%M:%S+00:00')
            ELSE strftime(p, '%Y-%m-%dT%H:%M:%S.%f+00:00') END, '') AS iso, coalesce(strftime(p, '%m-%d %H:%M'), '-') AS short
        FROM (SELECT event_id, event_type, {PARSED_SQL} AS p FROM events)""",
)
def time_display(d):
    parsed = iso_texts(d).withColumn("p", coerce.parse_ts("raw"))
    return parsed.select(
        "event_id",
        coerce.display_time("p").alias("shown"),
        coerce.iso_or_blank("p").alias("iso"),
        coerce.short_time("p").alias("short"),
    )


BLANK_SQL = "(t IS NULL OR lower(t) IN ('', 'nan', 'none', 'null', 'undefined', '<na>', 'nat', '-') OR (t LIKE '$%' AND len(t) <= 8))"


def words(d):
    """Texts with blanks among them: a $ token, a dash, a word, or the type."""
    size, number = F.col("p_size"), F.col("p_partkey").cast("string")
    value = (
        F.when(size <= 5, F.concat(F.lit("$"), number))
        .when(size <= 10, F.lit(" None "))
        .when(size <= 15, F.lit("-"))
        .when(size <= 20, F.concat(F.lit("$12345678"), number))
        .when(size <= 25, F.lit("0"))
        .when(size <= 30, F.lit(None))
        .otherwise(F.concat(F.lit(" "), F.col("p_type"), F.lit(" ")))
    )
    return d.raw("part").withColumn("value", value)


WORDS_SQL = """(SELECT *, trim(value) AS t FROM (SELECT *, CASE WHEN p_size <= 5 THEN '$' || p_partkey WHEN p_size <= 10 THEN ' None '
    WHEN p_size <= 15 THEN '-' WHEN p_size <= 20 THEN '$12345678' || p_partkey WHEN p_size <= 25 THEN '0'
    WHEN p_size <= 30 THEN NULL ELSE ' ' || p_type || ' ' END AS value FROM part))"""


@check("blank_flags", f"SELECT p_partkey, {BLANK_SQL} AS blank FROM {WORDS_SQL}")
def blank_flags(d):
    return words(d).select("p_partkey", coerce.is_blank("value").alias("blank"))


@check("first_non_empty", f"SELECT p_partkey, CASE WHEN {BLANK_SQL} THEN p_name ELSE value END AS chosen FROM {WORDS_SQL}")
def first_non_empty(d):
    return words(d).select("p_partkey", coerce.first_non_empty("value", F.lit("  "), "p_name").alias("chosen"))


@check("text_normalize", f"SELECT p_partkey, CASE WHEN {BLANK_SQL} THEN '' ELSE t END AS title, p_name AS model FROM {WORDS_SQL}")
def text_normalize(d):
    named = words(d).select("p_partkey", F.col("value").alias("title"), F.concat(F.lit(" "), "p_name").alias("model"))
    return text.normalize_text_columns(named)


@check("text_repair", "SELECT doc_id, text, text AS repaired FROM documents")
def text_repair(d):
    """Whole documents, mis-decoded and repaired: every text comes back."""
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    docs = d.raw("documents").select("doc_id", "text", broken.alias("broken"))
    return docs.select("doc_id", "text", text.repair_text("broken").alias("repaired"))


@check("list_or_text", f"SELECT p_partkey, concat_ws(', ', CASE WHEN NOT {BLANK_SQL} THEN t END, p_brand) AS joined FROM {WORDS_SQL}")
def list_or_text(d):
    return words(d).select("p_partkey", text.list_or_text(F.array("value", F.lit(" - "), "p_brand")).alias("joined"))


@check(
    "handle_normalize",
    """SELECT c_custkey, c_name AS one, '@' || c_name AS two, lower(c_name) AS tier FROM customer""",
)
def handle_normalize(d):
    return d.raw("customer").select(
        "c_custkey",
        text.normalize_handle(F.concat(F.lit(" @"), "c_name")).alias("one"),
        text.normalize_handle(F.concat(F.lit("@@"), "c_name")).alias("two"),
        text.tier_handle(F.concat(F.lit("@@"), "c_name")).alias("tier"),
    )


@check(
    "lyrics_bundle",
    f"SELECT p_partkey, concat_ws(chr(10) || chr(10), p_name, CASE WHEN NOT {BLANK_SQL} THEN t END, p_brand) AS lyrics FROM {WORDS_SQL}",
)
def lyrics_bundle(d):
    return words(d).select("p_partkey", text.lyrics_bundle("p_name", "value", "p_brand").alias("lyrics"))


@check(
    "stable_ids",
    """SELECT conv_id, turn, sha256(text)[1:24] AS url_hash,
         'generated_' || sha1(conv_id || '|' || '' || '|' || role || '|' || trim(text, ' \t\n\r')) AS comment_id FROM conversations""",
)
def stable_ids(d):
    return d.raw("conversations").select(
        "conv_id",
        "turn",
        text.url_hash("text").alias("url_hash"),
        text.stable_comment_id("conv_id", F.lit(None).cast("string"), "role", "text").alias("comment_id"),
    )


@check(
    "link_resolve",
    """SELECT request_id, CASE o_orderpriority WHEN '3-MEDIUM' THEN 'unsupported scheme' WHEN '5-LOW' THEN 'host not allowed'
         WHEN '4-NOT SPECIFIED' THEN 'empty url' END AS link_error,
         CASE WHEN o_orderpriority IN ('1-URGENT', '3-MEDIUM', '5-LOW') THEN uuid END AS item_id FROM v_queue
       UNION ALL SELECT 'page-' || page_id, 'host not allowed', NULL FROM pages""",
)
def link_resolve(d):
    pages = d.raw("pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("request_id"), "url")
    urls = d.queue().select("request_id", "url").unionByName(pages)
    return urls.select("request_id", text.link_error("url").alias("link_error"), text.link_item_id("url").alias("item_id"))


@check(
    "profile_clean",
    """SELECT page_id, url AS with_scheme, 'https://' || substr(url, strpos(url, '://') + 3) AS completed,
         trim(html, ' \t\n\r') AS plain, len(trim(html, ' \t\n\r')) > 2000 AS too_long FROM pages""",
)
def profile_clean(d):
    bare = F.substring_index("url", "://", -1)
    padded = F.concat(F.lit(" "), "html", F.lit("\u0000 "))
    return d.raw("pages").select(
        "page_id",
        text.normalize_url("url").alias("with_scheme"),
        text.normalize_url(bare).alias("completed"),
        text.plain_text(padded).alias("plain"),
        text.too_long(padded, 2000).alias("too_long"),
    )


@check(
    "moderation_flag",
    """SELECT doc_id, contains(t, 'wordless') OR contains(t, 'theheron') OR contains(t, 'êaux') AS flagged
       FROM (SELECT doc_id, replace(lower(text), ' ', '') AS t FROM documents)""",
)
def moderation_flag(d):
    terms = ("wordless", "theheron", "êaux")
    return d.raw("documents").select("doc_id", text.contains_listed_term("text", terms).alias("flagged"))


@check(
    "loudness_gain",
    f"""SELECT {LINE_SQL}, round(least(greatest(least(-14 - i, -1 - tp), -12), 6), 3) AS gain, round(least(-14 - i, -1 - tp), 2) AS upload,
          round(least(greatest(pow(10, least(-14 - i, -1 - tp) / 20), 0.05), 3), 6) AS clamped,
          round(pow(10, least(-14 - i, -1 - tp) / 20), 6) AS factor
        FROM (SELECT *, -l_quantity AS i, l_discount * 10 - l_tax * 50 AS tp FROM lineitem)""",
)
def loudness_gain(d):
    df = d.raw("lineitem").withColumns({"i": -F.col("l_quantity"), "tp": F.col("l_discount") * 10 - F.col("l_tax") * 50})
    raw = F.least(-14.0 - F.col("i"), -1.0 - F.col("tp"))
    return df.select(
        *LINE_KEYS,
        scores.normalization_gain("i", "tp").alias("gain"),
        scores.upload_gain("i", "tp").alias("upload"),
        F.round(scores.playback_factor(raw), 6).alias("clamped"),
        F.round(scores.playback_factor(raw, clamped=False), 6).alias("factor"),
    )


@check("comment_tokens", "SELECT comment_id, norm, array_to_string(tokens, ' ') AS tokens FROM v_comment_flags")
def comment_tokens(d):
    norm = d.comments().select("comment_id", comments.normalize_comment("content").alias("norm"))
    return norm.select("comment_id", "norm", F.array_join(comments.comment_tokens("norm"), " ").alias("tokens"))


@check("comment_symbol_only", "SELECT comment_id, symbol_only FROM v_comment_flags")
def comment_symbol_only(d):
    norm = d.comments().select("comment_id", comments.normalize_comment("content").alias("norm"))
    return norm.select("comment_id", comments.symbol_only("norm").alias("symbol_only"))


@check("comment_repeated", "SELECT comment_id, repeated FROM v_comment_flags")
def comment_repeated(d):
    norm = d.comments().select("comment_id", comments.normalize_comment("content").alias("norm"))
    return norm.select("comment_id", comments.repeated_characters("norm").alias("repeated"))


@check(
    "comment_mention_only",
    """SELECT comment_id, named OR (n = 1 AND len(tokens[1]) >= 3 AND NOT music AND NOT positive) AS mention_only
       FROM v_comment_flags""",
)
def comment_mention_only(d):
    norm = d.comments().withColumn("norm", comments.normalize_comment("content"))
    staged = norm.withColumn("tokens", comments.comment_tokens("norm"))
    flag = comments.mention_only(F.col("norm"), F.col("tokens"), F.col("user_mentions"))
    return staged.select("comment_id", flag.alias("mention_only"))


@check("comment_classify", "SELECT comment_id, quality_label, quality_weight FROM v_comments")
def comment_classify(d):
    return comments.classify(d.comments(), "content", "user_mentions").select("comment_id", "quality_label", "quality_weight")


@check(
    "style_tags",
    """SELECT p_partkey, p_brand || '|' || p_type || '|' || split_part(p_name, ' ', 1) AS tags FROM part""",
)
def style_tags(d):
    listed = F.concat("p_brand", F.lit(", ,"), "p_type", F.lit(" ,"), F.replace("p_name", F.lit(" "), F.lit(",")))
    return d.raw("part").select("p_partkey", F.array_join(text.style_tags(listed, 3), "|").alias("tags"))


@check(
    "upload_manifest_check",
    """SELECT doc_id, reason = '' AS ok, reason, ext FROM (
         SELECT doc_id, ext, CASE WHEN ext NOT IN ('en', 'fr') THEN 'extension not allowed'
           WHEN n_chars * 2000 > 4 * 1024 * 1024 THEN 'file too large' ELSE '' END AS reason
         FROM (SELECT *, lower(lang) AS ext FROM documents))""",
)
def upload_manifest_check(d):
    name = F.concat(F.col("source"), F.lit("."), F.upper("lang"))
    ok, reason, ext = text.upload_check(name, F.col("n_chars") * 2000, ("en", "fr"), 4)
    return d.raw("documents").select("doc_id", ok.alias("ok"), reason.alias("reason"), ext.alias("ext"))


