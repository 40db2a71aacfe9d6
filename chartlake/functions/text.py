"""Text columns: encoding repair, cleaning, handles, tags, links, moderation."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartlake.config import LinkConfig
from chartlake.functions.coerce import (
    BLANK_TOKENS,
    any_of,
    col,
    is_blank,
    non_blank,
    strip,
)

# Characters that UTF-8 text leaves behind when it was decoded as
# a single-byte western encoding.
BROKEN_MARKERS = (
    "Ã", "ã", "Â", "â", "ð", "Ð", "Ñ", "Î", "Ï",
    "Å", "¤", "¦", "§", "¨", "©", "ª", "«", "¬", "®", "¯", "°", "±", "²", "³",
    "ì", "í", "ë", "ê", "è", "é", "ç",
)
MARKER_PENALTY = 3
CONTROL_PENALTY = 5
SHORT_TEXT = 8
REPAIR_ROUNDS = 3

# Catalogue columns that hold free text.
TEXT_COLUMNS = (
    "title", "handle", "display_name", "artist_display_name", "model",
    "major_model_version", "display_tags", "lyrics", "prompt",
    "gpt_description_prompt", "comment_quality_summary", "source",
)

UUID_PATTERN = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


# Characters of the Windows western code page at 0x80 to 0x9F, in order;
# a blank stands for an unused byte.
WINDOWS_CHARACTERS = "€ ‚ƒ„…†‡ˆ‰Š‹Œ Ž  ‘’“”•–—˜™š›œ žŸ"
WINDOWS = "".join(c for c in WINDOWS_CHARACTERS if c != " ")
WINDOWS_CONTROLS = "".join(chr(0x80 + i) for i, c in enumerate(WINDOWS_CHARACTERS) if c != " ")
CONTROLS = "".join(map(chr, range(0x80, 0xA0)))
REPLACEMENT, STAND_IN = "\ufffd", "\U0010ffff"
SPELLED_REPLACEMENT, SPELLED_STAND_IN = (c.encode().decode("latin1") for c in (REPLACEMENT, STAND_IN))
# Characters outside of each code page.
NOT_LATIN = "[^\u0000-\u00ff]"
NOT_WINDOWS = f"[^\u0000-\u007f\u00a0-\u00ff{WINDOWS}]"


def _damage(text: Column) -> Column:
    marked = F.regexp_count(text, F.lit(f"[{''.join(BROKEN_MARKERS)}]"))
    controls = F.regexp_count(text, F.lit(f"[{CONTROLS}]"))
    return MARKER_PENALTY * marked + CONTROL_PENALTY * controls + F.greatest(F.lit(0), SHORT_TEXT - F.length(text))


def _redecoded(text: Column) -> Column:
    """UTF-8 reading of a text's bytes; null where there is none.

    Of the two code pages at most one has a reading of its own: Latin-1 if no character
    is above it, else Windows.
    """
    above = F.regexp_like(text, F.lit(NOT_LATIN))
    windows = F.when(~F.regexp_like(text, F.lit(NOT_WINDOWS)), F.translate(text, WINDOWS, WINDOWS_CONTROLS))
    narrow = F.when(above, windows).otherwise(text)
    return F.try_validate_utf8(F.encode(narrow, "ISO-8859-1").cast("string"))


def _redecoded_parts(text: Column) -> list[Column]:
    """Readings of what remains of a text without the characters that do not fit."""
    out = []
    for outside, windows in ((NOT_LATIN, False), (NOT_WINDOWS, True)):
        kept = F.regexp_replace(text, outside, "")
        narrow = F.translate(kept, WINDOWS, WINDOWS_CONTROLS) if windows else kept
        # A replacement character that the text spells out is kept under another one.
        held = F.replace(narrow, F.lit(SPELLED_REPLACEMENT), F.lit(SPELLED_STAND_IN))
        valid = F.make_valid_utf8(F.encode(held, "ISO-8859-1").cast("string"))
        out.append(F.translate(F.translate(valid, REPLACEMENT, ""), STAND_IN, REPLACEMENT))
    return out


def _least_damaged(text: Column, lossy: bool) -> Column:
    """Best of the readings that up to ``REPAIR_ROUNDS`` rounds of decoding give."""

    def readings(t: Column) -> Column:
        whole = _redecoded(t)
        if not lossy:
            return F.array(whole)
        latin, windows = _redecoded_parts(t)
        return F.array(F.when(~F.regexp_like(t, F.lit(NOT_LATIN)), whole), latin, whole, windows)

    def step(acc, _):
        read = F.flatten(F.transform(acc["last"], readings))
        new = F.array_except(F.filter(read, lambda t: F.coalesce(t, F.lit("")) != ""), acc["seen"])
        grown = F.transform(F.array(new), lambda n: F.struct(F.concat(acc["seen"], n).alias("seen"), n.alias("last")))
        return F.element_at(grown, 1)

    def best(seen: Column) -> Column:
        ranked = F.transform(seen, lambda t, i: F.struct(_damage(t).alias("damage"), i.alias("place"), t.alias("text")))
        return F.when(F.size(seen) == 1, seen[0]).otherwise(F.array_min(ranked)["text"])

    start = F.struct(F.array(text).alias("seen"), F.array(text).alias("last"))
    seen = F.aggregate(F.sequence(F.lit(1), F.lit(REPAIR_ROUNDS)), start, step, lambda acc: acc["seen"])
    return _once(seen, best)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` written (and computed) once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repair_text(c: Column | str, lossy: bool = False) -> Column:
    """Undo double decoding of UTF-8 text, by built-in functions.

    Only texts with characters of the Latin-1 upper half are examined. ``lossy=True``
    also admits readings that drop undecodable characters, which shortens correctly
    accented text; the default never does.
    """
    value = F.when(is_blank(c), F.lit("")).otherwise(col(c).cast("string"))
    suspicious = F.lit("[\u0080-\u00ff]")
    return _once(value, lambda v: F.when(F.regexp_like(v, suspicious), _least_damaged(v, lossy)).otherwise(v))


def clean_text(c: Column | str, repair: bool = True, lossy: bool = False) -> Column:
    """Repaired, trimmed text; blanks become the empty text."""

    def unblank(text: Column) -> Column:
        return F.when(F.lower(text).isin(*BLANK_TOKENS), F.lit("")).otherwise(text)

    if repair:
        return _once(strip(repair_text(c, lossy)), unblank)
    return unblank(strip(F.when(is_blank(c), F.lit("")).otherwise(col(c).cast("string"))))


def normalize_text_columns(
    df: DataFrame, columns: Sequence[str] = TEXT_COLUMNS, repair: bool = True, lossy: bool = False
) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: clean_text(c, repair, lossy) for c in present})


def list_or_text(items: Column | str) -> Column:
    """Array of texts to one text: cleaned non-blank parts joined by a comma."""
    kept = F.filter(col(items), lambda x: ~is_blank(x))
    return F.coalesce(F.array_join(F.transform(kept, strip), ", "), F.lit(""))


def normalize_handle(c: Column | str, repair: bool = False) -> Column:
    """Handle without one leading ``@``."""
    return F.regexp_replace(clean_text(c, repair), "^@", "")


def tier_handle(c: Column | str) -> Column:
    """Handle form used for member tests: lower case, all leading ``@`` removed."""
    text = F.lower(strip(F.coalesce(col(c).cast("string"), F.lit(""))))
    return F.ltrim(text, F.lit("@"))


def creator_display(display_name: Column | str, handle: Column | str) -> tuple[Column, Column]:
    """(primary name, "@handle" or empty)."""
    name = clean_text(display_name, repair=False)
    bare = normalize_handle(handle)
    primary = F.when(name != "", name).when(bare != "", bare).otherwise(F.lit("-"))
    secondary = F.when(bare != "", F.concat(F.lit("@"), bare)).otherwise(F.lit(""))
    return primary, secondary


def community_creator(artist: Column | str, profile_name: Column | str) -> Column:
    return F.coalesce(F.nullif(col(artist), F.lit("")), F.nullif(col(profile_name), F.lit("")), F.lit("Unknown"))


def lyrics_bundle(*parts: Column | str) -> Column:
    """Non-blank parts joined by an empty line."""
    texts = F.array(*[strip(non_blank(p)) for p in parts])
    return F.array_join(F.filter(texts, lambda t: t.isNotNull()), "\n\n")


def style_tags(c: Column | str, k: int) -> Column:
    """First ``k`` non-blank comma-separated tags."""
    tags = F.transform(F.split(F.coalesce(col(c), F.lit("")), ","), strip)
    return F.slice(F.filter(tags, lambda t: t != ""), 1, k)


def plain_text(c: Column | str) -> Column:
    """NUL-free trimmed text."""
    return strip(F.replace(F.coalesce(col(c), F.lit("")), F.lit("\u0000"), F.lit("")))


def too_long(c: Column | str, max_len: int) -> Column:
    """True for a text beyond a field limit; such a value is refused, never cut."""
    return F.length(plain_text(c)) > max_len


def normalize_url(c: Column | str) -> Column:
    """Trimmed link, completed by a scheme where it has none."""
    text = plain_text(c)
    has_scheme = F.regexp_like(text, F.lit("(?i)^https?://"))
    return F.when((text == "") | has_scheme, text).otherwise(F.concat(F.lit("https://"), text))


def contains_listed_term(c: Column | str, terms: Sequence[str]) -> Column:
    """Case- and space-insensitive word-list test; the list belongs to the caller."""
    if not terms:
        return F.lit(False)
    compact = F.replace(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(" "), F.lit(""))
    return any_of(*[F.contains(compact, F.lit(t)) for t in terms])


def url_hash(c: Column | str) -> Column:
    return F.substring(F.sha2(F.coalesce(col(c), F.lit("")), 256), 1, 24)


def stable_comment_id(song_id, created_at, handle, content) -> Column:
    """Reproducible id of a comment that arrived without one."""
    parts = [F.coalesce(strip(col(p).cast("string")), F.lit("")) for p in (song_id, created_at, handle, content)]
    return F.concat(F.lit("generated_"), F.sha1(F.concat_ws("|", *parts)))


def link_parts(url: Column | str) -> dict[str, Column]:
    text = F.coalesce(strip(url), F.lit(""))
    return {
        "text": text,
        "scheme": F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)),
        "host": F.lower(F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)),
        "path": F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1),
    }


def link_error(url: Column | str, cfg: LinkConfig = LinkConfig()) -> Column:
    """Reason why an item link is refused, or null when it is accepted."""
    p = link_parts(url)
    return (
        F.when(p["text"] == "", F.lit("empty url"))
        .when(~p["scheme"].isin("http", "https"), F.lit("unsupported scheme"))
        .when(~p["host"].isin(*cfg.hosts), F.lit("host not allowed"))
        .when(~(p["path"].startswith("/song/") | p["path"].startswith("/s/")), F.lit("unsupported path"))
    )


def link_item_id(url: Column | str) -> Column:
    """First UUID in a link, or null."""
    return F.nullif(F.regexp_extract(F.coalesce(col(url), F.lit("")), f"({UUID_PATTERN})", 1), F.lit(""))


def upload_check(name: Column | str, size_bytes: Column | str, extensions: Sequence[str], max_mb: int):
    """(ok, reason, extension) of an upload manifest row."""
    text = F.coalesce(col(name), F.lit(""))
    ext = F.when(F.contains(text, F.lit(".")), F.lower(F.element_at(F.split(text, r"\."), -1))).otherwise(F.lit(""))
    too_big = F.coalesce(col(size_bytes), F.lit(0)) > max_mb * 1024 * 1024
    reason = (
        F.when(text == "", F.lit("missing file"))
        .when(~ext.isin(*extensions), F.lit("extension not allowed"))
        .when(too_big, F.lit("file too large"))
        .otherwise(F.lit(""))
    )
    return reason == "", reason, ext
