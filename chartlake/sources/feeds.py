"""Landed JSON: feed pages, item pages, comment pages and item records."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartlake.config import LinkConfig
from chartlake.functions.coerce import any_of, as_ts, blank_sql, is_blank, parse_ts, strip, to_number
from chartlake.functions.comments import MENTIONS
from chartlake.functions.text import TEXT_COLUMNS, clean_text

OBJECT_MARKER = '"clip":'
FEED_SCHEMA = "feed struct<items array<struct<content_type string, content_item string>>, next_cursor string>"
CONTEST_REASON = "remix_contest"
_REPLY = [
    T.StructField("id", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("user_handle", T.StringType()),
    T.StructField("user_display_name", T.StringType()),
    T.StructField("num_likes", T.LongType()),
    T.StructField("num_replies", T.LongType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("user_mentions", MENTIONS),
]
COMMENT_PAGE = T.StructType(
    [
        T.StructField("total_count", T.LongType()),
        T.StructField(
            "results",
            T.ArrayType(T.StructType([*_REPLY, T.StructField("replies", T.ArrayType(T.StructType(_REPLY)))])),
        ),
    ]
)


def feed_items(pages: DataFrame, body: str = "body") -> DataFrame:
    """Items of feed pages: clips with an id, with a contest flag."""
    keep = [c for c in pages.columns if c != body]
    parsed = pages.select(*keep, F.from_json(body, FEED_SCHEMA).alias("_p"))
    items = parsed.select(*keep, F.posexplode("_p.feed.items").alias("item_position", "_i"))
    record = F.col("_i.content_item")
    clips = items.where(F.col("_i.content_type") == "clip").select(
        *keep, "item_position", F.get_json_object(record, "$.id").alias("id"), record.alias("record")
    )
    return clips.where(F.coalesce(F.col("id"), F.lit("")) != "").withColumn("is_contest", contest_flag("record"))


def contest_flag(record: str) -> Column:
    """Any of: two flags, non-empty contest ids, the contest reason."""

    def field(path):
        return F.coalesce(F.get_json_object(record, path), F.lit(""))

    ids = field("$.metadata.contest_ids")
    return any_of(
        field("$.is_contest_clip") == "true",
        field("$.is_contest_base_clip") == "true",
        ~ids.isin("", "[]", "{}", "0", "false"),
        field("$.download_disabled_reason") == CONTEST_REASON,
    )


def embedded_object(body: str = "body", marker: str = OBJECT_MARKER) -> Column:
    """JSON object after the first marker in a page text; null when there is none.

    The JSON reader stops at the end of the object, so braces and quotes inside
    its texts and whatever follows it need no scan of their own.
    """
    tail = F.substring_index(F.col(body), marker, 1)
    after = F.substring(F.col(body), F.length(tail) + F.lit(len(marker) + 1), F.length(body))
    start = F.instr(after, "{")
    found = F.contains(F.col(body), F.lit(marker)) & (start > 0)
    text = F.substring(after, start, F.length(after))
    return F.to_json(F.try_parse_json(F.when(found, text)))


def flatten_comments(pages: DataFrame, cap: int | None = None, max_pages: int | None = None) -> DataFrame:
    """Comments and replies of landed pages (song_id, page_no, body).

    Rows without content are dropped. ``max_pages`` and ``cap`` limit the pages and
    the top-level comments per song (in page order; replies do not count); without
    them every page is flattened where it lies, without a shuffle.
    """
    used = pages if max_pages is None else pages.where(F.col("page_no") < max_pages)
    parsed = used.select("song_id", "page_no", F.from_json("body", COMMENT_PAGE)["results"].alias("_r"))
    if cap is not None:
        before = Window.partitionBy("song_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
        sized = parsed.withColumn("_r", F.coalesce("_r", F.array().cast(parsed.schema["_r"].dataType)))
        taken = sized.withColumn("_room", F.lit(cap) - F.coalesce(F.sum(F.size("_r")).over(before), F.lit(0)))
        room = F.greatest(F.col("_room"), F.lit(0)).cast("int")
        parsed = taken.select("song_id", F.slice("_r", F.lit(1), room).alias("_r"))
    rows = parsed.select("song_id", F.explode("_r").alias("_c"))

    def shape(c, reply: bool):
        replies = F.lit(0).cast("long") if reply else F.coalesce(c["num_replies"], F.lit(0).cast("long"))
        return F.struct(
            F.coalesce(c["id"], F.lit("")).alias("comment_id"),
            strip(F.coalesce(c["content"], F.lit(""))).alias("content"),
            F.coalesce(c["user_handle"], F.lit("")).alias("user_handle"),
            F.coalesce(c["user_display_name"], F.lit("")).alias("user_display_name"),
            F.coalesce(c["num_likes"], F.lit(0).cast("long")).alias("num_likes"),
            replies.alias("num_replies"),
            F.coalesce(c["created_at"], F.lit("")).alias("created_at"),
            F.lit(reply).alias("is_reply"),
            c["user_mentions"].alias("user_mentions"),
        )

    replies = F.coalesce(F.transform("_c.replies", lambda r: shape(r, True)), F.array())
    both = F.concat(F.array(shape(F.col("_c"), False)), replies)
    return rows.select("song_id", F.inline(both)).where(F.col("content") != "")


# Item records ----------------------------------------------------------------
# Where each field may be found, in order. "s" is the record
# itself, "c" its clip, "u" its user, "m" its metadata.
FIELD_PATHS = {
    "id": ("s.id", "c.id"),
    "created_at": (
        "s.created_at", "s.createdAt", "s.created", "c.created_at", "c.createdAt", "m.created_at", "m.createdAt",
    ),
    "title": ("s.title", "c.title", "m.title"),
    "handle": ("s.handle", "u.handle", "m.handle"),
    "display_name": (
        "s.display_name", "s.displayName", "u.display_name", "u.displayName", "m.display_name", "m.displayName",
    ),
    "user_id": ("s.user_id", "s.userId", "u.id", "m.user_id"),
    "audio_url": (
        "s.audio_url", "s.audioUrl", "s.audio_url_mp3", "s.stream_audio_url", "s.streamAudioUrl",
        "c.audio_url", "c.audioUrl", "m.audio_url", "m.audioUrl",
    ),
    "image_url": (
        "s.image_url", "s.imageUrl", "s.image_large_url", "s.imageLargeUrl", "c.image_url", "c.imageUrl",
        "m.image_url", "m.imageUrl", "m.image_large_url",
    ),
    "model": ("s.model_name", "s.model", "m.model_name", "m.model", "s.major_model_version", "m.major_model_version"),
    "major_model_version": ("s.major_model_version", "m.major_model_version"),
    "duration": ("s.duration", "c.duration", "m.duration"),
    "play_count": ("s.play_count", "s.playCount", "c.play_count"),
    "upvote_count": ("s.upvote_count", "s.upvoteCount", "s.like_count", "s.likeCount", "c.upvote_count"),
    "comment_count": ("s.comment_count", "s.commentCount", "c.comment_count"),
    "flag_count": ("s.flag_count", "s.flagCount", "c.flag_count"),
    "is_contest_clip": ("s.is_contest_clip",),
    "download_disabled_reason": ("s.download_disabled_reason",),
    "is_public": ("s.is_public",),
    "is_hidden": ("s.is_hidden",),
    "is_trashed": ("s.is_trashed",),
    "explicit": ("s.explicit",),
    "song_url": ("s.song_url", "s.songUrl"),
}
# Fields that are text only: a list or object there counts as no value.
PLAIN_TEXT_PATHS = {
    "prompt": ("s.prompt", "c.prompt", "m.prompt", "s.lyric", "m.lyric"),
    "lyrics": ("s.lyrics", "c.lyrics", "m.lyrics", "s.lyric", "c.lyric", "m.lyric"),
    "gpt_description_prompt": (
        "s.gpt_description_prompt", "c.gpt_description_prompt", "m.gpt_description_prompt",
        "s.gpt_description", "c.gpt_description", "m.gpt_description", "s.description", "m.description",
    ),
}
# Fields that may be a list of texts, joined by a comma.
LIST_PATHS = {
    "display_tags": ("s.display_tags", "c.display_tags", "m.display_tags", "m.tags", "s.tags"),
    "contest_ids": ("m.contest_ids", "s.contest_ids"),
}
COUNTER_FIELDS = ("play_count", "upvote_count", "comment_count", "flag_count")
FLAG_FIELDS = ("is_contest_clip", "is_public", "is_hidden", "is_trashed", "explicit")
NESTED = {"c": "clip", "u": "user", "m": "metadata"}


# Fields where a text may itself start like a list or an object.
FREE_TEXT = ("title", "handle", "display_name", *PLAIN_TEXT_PATHS, *LIST_PATHS)


def _paths(name: str) -> tuple[str, ...]:
    return FIELD_PATHS.get(name) or PLAIN_TEXT_PATHS.get(name) or LIST_PATHS[name]


def record_schema(fields: Sequence[str]) -> T.StructType:
    """All paths of ``fields``: free-text leaves keep their kind, others are read as text."""
    wanted: dict[str, dict[str, T.DataType]] = {"s": {}, "c": {}, "u": {}, "m": {}}
    for name in fields:
        for path in _paths(name):
            part, key = path.split(".")
            if name in FREE_TEXT:
                wanted[part][key] = T.VariantType()
            else:
                wanted[part].setdefault(key, T.StringType())
    leaves = {p: [T.StructField(n, kind) for n, kind in names.items()] for p, names in wanted.items()}
    nested = [T.StructField(NESTED[p], T.StructType(leaves[p])) for p in NESTED if leaves[p]]
    return T.StructType(leaves["s"] + nested)


def _leaf(root: str, path: str) -> str:
    part, key = path.split(".")
    return f"{root}.{key}" if part == "s" else f"{root}.{NESTED[part]}.{key}"


def _field(name: str) -> Column:
    """First non-blank value of a field.

    Free-text leaves keep their kind, which tells a text that looks like JSON from a
    nested value.
    """
    values = []
    for p in _paths(name):
        text = _leaf("_t", p)
        if name in FREE_TEXT:
            leaf = text
            kind = f"schema_of_variant({leaf})"
            listed = f"CASE WHEN {kind} LIKE 'ARRAY%' THEN try_variant_get({leaf}, '$', 'array<string>') END"
            text = f"CASE WHEN {kind} NOT LIKE 'ARRAY%' AND {kind} NOT LIKE 'OBJECT%' THEN try_variant_get({leaf}, '$', 'string') END"
        if name in LIST_PATHS:
            kept = f"transform(filter({listed}, x -> NOT {blank_sql('x')}), x -> trim(x))"
            text = f"coalesce(array_join({kept}, ', '), {text})"
        values.append(text)
    blank = blank_sql("x", json_text=name not in FREE_TEXT)
    return F.expr(f"try_element_at(filter(array({', '.join(values)}), x -> NOT {blank}), 1)")


def flatten_records(
    records: DataFrame,
    previous: DataFrame | None,
    as_of: str,
    source: str = "public",
    links: LinkConfig = LinkConfig(),
    repair: bool = True,
) -> DataFrame:
    """Catalogue rows of item records (id, record JSON text).

    Every field takes its first non-blank path, then the previous row, then its
    default. ``previous`` is the catalogue before; columns the record does not
    cover are kept from it.
    """
    names = (*FIELD_PATHS, *PLAIN_TEXT_PATHS, *LIST_PATHS)
    parsed = records.select(
        F.col("id").alias("_key"),
        F.from_json("record", record_schema(names)).alias("_t"),
    )
    fresh = parsed.select("_key", *[_field(n).alias(f"_n_{n}") for n in names])
    fresh = fresh.withColumn("_n_lyrics", F.coalesce("_n_lyrics", "_n_prompt"))
    old_columns = [] if previous is None else previous.columns
    if previous is None:
        joined = fresh
    else:
        renamed = previous.select(F.col("id").alias("_key"), *[F.col(c).alias(f"_o_{c}") for c in previous.columns])
        joined = fresh.join(renamed, "_key", "left")

    def old(name: str, kind: str | None = None) -> Column:
        c = F.col(f"_o_{name}") if name in old_columns else F.lit(None)
        return c if kind is None else c.cast(kind)

    def text(name: str) -> Column:
        if name not in old_columns:
            return F.col(f"_n_{name}")
        prior = f"CAST(_o_{name} AS STRING)"
        return F.expr(f"coalesce(_n_{name}, CASE WHEN NOT {blank_sql(prior)} THEN {prior} END)")

    def cleaned(name: str, c: Column) -> Column:
        return clean_text(c, repair) if name in TEXT_COLUMNS else c

    out = {"id": F.coalesce(text("id"), F.col("_key"))}
    for name in names:
        if name in ("id", "created_at", "title", "song_url", "duration", *COUNTER_FIELDS, *FLAG_FIELDS):
            continue
        out[name] = cleaned(name, text(name))
    out["title"] = cleaned("title", F.coalesce(text("title"), F.lit("Untitled")))
    out["created_at"] = F.coalesce(parse_ts("_n_created_at"), old("created_at", "timestamp_ntz"))
    out["duration"] = F.coalesce(to_number("_n_duration", None), old("duration", "double"))
    for name in COUNTER_FIELDS:
        out[name] = F.coalesce(to_count_or_null(F.col(f"_n_{name}")), old(name, "long"), F.lit(0).cast("long"))
    for name in FLAG_FIELDS:
        out[name] = F.coalesce(F.col(f"_n_{name}").try_cast("boolean"), old(name, "boolean"))
    out["song_url"] = F.coalesce(
        F.col("_n_song_url"), F.concat(F.lit(links.item_url_prefix), out["id"]), old("song_url", "string")
    )
    out["first_seen_at"] = F.coalesce(old("first_seen_at", "timestamp_ntz"), as_ts(as_of))
    out["last_checked_at"] = as_ts(as_of)
    prior_source = old("source", "string")
    out["source"] = F.coalesce(F.when(~is_blank(prior_source), prior_source), F.lit(source))
    out["status"] = F.lit("active")
    out["fetch_fail_count"] = F.lit(0).cast("long")
    out["last_fetch_error"] = F.lit("")
    untouched = {c: F.col(f"_o_{c}") for c in old_columns if c not in out}
    return joined.select(*[c.alias(n) for n, c in (out | untouched).items()])


def to_count_or_null(c: Column) -> Column:
    return to_number(c, None).try_cast("long")
