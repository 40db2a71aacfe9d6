"""Comment text classification as one native expression (no Python per row)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartlake.functions.coerce import col, strip

# The three lexicons of the classifier.
MUSIC_TERMS = (
    "song", "track", "beat", "beats", "vocal", "vocals", "voice", "mix", "mixing",
    "melody", "melodies", "lyrics", "lyric", "chorus", "hook", "drop", "bass",
    "drums", "guitar", "piano", "synth", "sound", "sounds", "production",
    "arrangement", "vibe", "energy", "genre", "style", "flow", "rhythm",
    "master", "mastering", "instrumental", "verse", "bridge", "intro", "outro",
)
POSITIVE_TERMS = (
    "good", "great", "amazing", "awesome", "nice", "cool", "love", "loved",
    "enjoy", "enjoyed", "beautiful", "fire", "banger", "excellent", "perfect",
    "favorite", "fav", "incredible", "wonderful", "fantastic", "dope",
)
SHORT_REACTIONS = (
    "nice", "good", "cool", "fire", "wow", "great", "amazing", "awesome",
    "love", "liked", "dope", "banger", "first", "lol", "ok", "yes", "no",
)
# Label -> weight.
LABEL_WEIGHTS = {
    "empty": 0.0,
    "emoji_only": 0.0,
    "repeated": 0.1,
    "mention_only": 0.0,
    "generic_short": 0.35,
    "too_short": 0.15,
    "generic_positive": 0.55,
    "meaningful_music": 1.0,
    "meaningful_reaction": 0.85,
    "meaningful_long": 0.75,
    "generic": 0.45,
}
# Fixed value: what counts as a token.
TOKEN_PATTERN = "[a-zA-Z0-9가-힣]+"
MENTIONS = T.ArrayType(
    T.StructType([T.StructField("handle", T.StringType()), T.StructField("display_name", T.StringType())])
)


# White space of every script, inside a character class.
SPACE_CLASS = r"\s\x1c-\x1f\x85\p{Z}"


def normalize_comment(c: Column | str) -> Column:
    """Lower case, links removed, white space collapsed."""
    lowered = F.lower(strip(F.coalesce(col(c), F.lit(""))))
    no_links = F.regexp_replace(lowered, rf"https?://[^{SPACE_CLASS}]+", "")
    return strip(F.regexp_replace(no_links, rf"[{SPACE_CLASS}]+", " "))


def comment_tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col(c)), F.lit(TOKEN_PATTERN), F.lit(0))


def symbol_only(c: Column | str) -> Column:
    """No letter or digit of any script and at least one symbol or punctuation mark."""
    has_word = F.regexp_like(col(c), F.lit(r"[\p{L}\p{N}]"))
    has_symbol = F.regexp_like(col(c), F.lit(r"[\p{S}\p{P}]"))
    return (col(c) == "") | (~has_word & has_symbol)


def repeated_characters(c: str) -> Column:
    """At least four characters besides white space, of at most two kinds.

    ``c`` is a normalised text column. Ordinary texts leave at the first test:
    more than two kinds of characters within the first few decide it.
    """
    head_kinds = f"size(array_distinct(split(replace(substr({c}, 1, 12), ' ', ''), '')))"
    rest = f"translate({c}, concat(' ', substr({c}, 1, 1)), '')"
    one_more = f"replace({rest}, substr({rest}, 1, 1), '') = ''"
    whole = f"length(replace({c}, ' ', '')) >= 4 AND ({rest} = '' OR {one_more})"
    return F.expr(f"CASE WHEN {c} = '' OR {head_kinds} > 2 THEN false ELSE {whole} END")


def _mention_names(mentions: Column) -> Column:
    both = F.concat(
        F.transform(mentions, lambda m: m["handle"]), F.transform(mentions, lambda m: m["display_name"])
    )
    return F.filter(F.transform(both, normalize_comment), lambda n: n != "")


def mention_only(text: Column, tokens: Column, mentions: Column) -> Column:
    """Only a mention: of a named user, or one word outside both lexicons."""
    names = F.coalesce(_mention_names(mentions), F.array().cast("array<string>"))
    joined = F.array_join(tokens, " ")
    same_tokens = F.exists(names, lambda n: F.array_join(comment_tokens(n), " ") == joined)
    word = F.try_element_at(tokens, F.lit(1))
    unknown_word = ~word.isin(*POSITIVE_TERMS) & ~word.isin(*MUSIC_TERMS) & (F.length(word) >= 3)
    return (
        F.array_contains(names, text)
        | ((F.size(tokens) <= 2) & same_tokens)
        | ((F.size(tokens) == 1) & F.coalesce(unknown_word, F.lit(False)))
    )


def _terms(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def label_weight(label: Column | str) -> Column:
    weights = F.create_map(*[F.lit(x) for pair in LABEL_WEIGHTS.items() for x in pair])
    return F.try_element_at(weights, col(label))


def classify(df: DataFrame, content: str = "content", mentions: str | None = None) -> DataFrame:
    """Add ``quality_label`` and ``quality_weight``; the first matching rule wins."""
    named = F.col(mentions) if mentions else F.lit(None).cast(MENTIONS)
    staged = (
        df.withColumn("_text", normalize_comment(content))
        .withColumn("_tokens", comment_tokens("_text"))
        .withColumns(
            {
                "_n": F.size("_tokens"),
                "_music": F.arrays_overlap("_tokens", _terms(MUSIC_TERMS)),
                "_positive": F.arrays_overlap("_tokens", _terms(POSITIVE_TERMS)),
            }
        )
    )
    n, music, positive = F.col("_n"), F.col("_music"), F.col("_positive")
    short = F.when(F.col("_text").isin(*SHORT_REACTIONS) | positive, "generic_short").otherwise("too_short")
    label = (
        F.when(F.col("_text") == "", "empty")
        .when(symbol_only("_text"), "emoji_only")
        .when(repeated_characters("_text"), "repeated")
        .when(mention_only(F.col("_text"), F.col("_tokens"), named), "mention_only")
        .when(n <= 2, short)
        .when((n <= 4) & positive & ~music, "generic_positive")
        .when(music & (n >= 4), "meaningful_music")
        .when(positive & (n >= 5), "meaningful_reaction")
        .when(n >= 8, "meaningful_long")
        .otherwise("generic")
    )
    return (
        staged.withColumn("quality_label", label)
        .withColumn("quality_weight", label_weight("quality_label"))
        .drop("_text", "_tokens", "_n", "_music", "_positive")
    )


def quality_bucket(label: Column | str) -> Column:
    """Bucket of a label: meaningful, mention_only, emoji_only (with repeated) or generic."""
    c = col(label)
    return (
        F.when(c.startswith("meaningful"), "meaningful")
        .when(c == "mention_only", "mention_only")
        .when(c.isin("emoji_only", "repeated"), "emoji_only")
        .otherwise("generic")
    )
