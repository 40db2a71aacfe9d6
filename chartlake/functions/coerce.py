"""Column helpers: blanks, numbers and timestamps (the only null/NaN gates)."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that count as "no value".
BLANK_TOKENS = ("", "nan", "none", "null", "undefined", "<na>", "nat", "-")
# A "$..." reference token of at most this length carries no content.
REFERENCE_TOKEN_LENGTH = 8
# Characters removed at both ends of a text.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
NUMBER_PATTERN = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"
HOUR_SECONDS = 3600.0


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WHITESPACE))


def is_blank(c: Column | str) -> Column:
    """True for null, blank tokens and short ``$`` reference tokens."""
    text = strip(col(c).cast("string"))
    token = text.startswith("$") & (F.length(text) <= REFERENCE_TOKEN_LENGTH)
    return F.coalesce(F.lower(text).isin(*BLANK_TOKENS) | token, F.lit(True))


def is_blank_json(c: Column | str) -> Column:
    """Blank test of a value kept as JSON text: objects and ``[]`` are blank too."""
    text = strip(c)
    is_object = text.startswith("{")
    is_empty_list = F.regexp_like(text, F.lit(r"^\[\s*\]$"))
    return is_blank(c) | F.coalesce(is_object | is_empty_list, F.lit(False))


def blank_sql(name: str, json_text: bool = False) -> str:
    """The blank test as SQL text over a column or lambda variable.

    For wide projections and lambdas: one parsed expression instead of many
    column calls.
    """
    space = "".join(f"\\u{ord(ch):04x}" for ch in WHITESPACE)
    text = f"btrim({name}, '{space}')"
    tokens = ", ".join(f"'{t}'" for t in BLANK_TOKENS)
    test = f"lower({text}) IN ({tokens}) OR (startswith({text}, '$') AND length({text}) <= {REFERENCE_TOKEN_LENGTH})"
    if json_text:
        test += f" OR startswith({text}, '{{') OR {text} RLIKE '^\\\\[\\\\s*\\\\]$'"
    return f"coalesce({test}, true)"


def non_blank(c: Column | str) -> Column:
    """The value, or null when it is blank."""
    return F.when(~is_blank(c), col(c))


def first_non_empty(*values: Column | str) -> Column:
    """Blank-aware coalesce; 0 and false are values, not blanks."""
    return F.coalesce(*[non_blank(v) for v in values])


def to_number(c: Column | str, default: float | None = 0.0) -> Column:
    """Double of a text or number; anything that is not a number gives ``default``."""
    text = strip(col(c).cast("string"))
    number = F.when(F.regexp_like(text, F.lit(NUMBER_PATTERN)), text.try_cast("double"))
    return number if default is None else F.coalesce(number, F.lit(float(default)))


def to_count(c: Column | str, default: int = 0) -> Column:
    """Whole number by truncation; non-numbers give ``default``."""
    return F.coalesce(to_number(c, None).try_cast("long"), F.lit(default).cast("long"))


def null_if_nan(c: Column | str) -> Column:
    return F.nanvl(col(c), F.lit(None).cast("double"))


def parse_ts(c: Column | str) -> Column:
    """Timestamp (UTC, without zone) of mixed ISO texts; errors give null."""
    return F.try_to_timestamp(strip(c)).cast("timestamp_ntz")


def ts_text(c: Column | str) -> Column:
    """Canonical timestamp text with microseconds and a UTC offset."""
    return F.concat(F.date_format(col(c), "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def display_time(c: Column | str) -> Column:
    return F.coalesce(F.date_format(col(c), "yyyy-MM-dd HH:mm 'UTC'"), F.lit("-"))


def iso_or_blank(c: Column | str) -> Column:
    """ISO text: fractional digits only where the value has them."""
    base = F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(col(c), "SSSSSS")
    fraction = F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros))
    return F.coalesce(F.concat(base, fraction, F.lit("+00:00")), F.lit(""))


def short_time(c: Column | str) -> Column:
    return F.coalesce(F.date_format(col(c), "MM-dd HH:mm"), F.lit("-"))


def hours_between(start: Column | str, end: Column | str) -> Column:
    """Exact hours from start to end (microsecond resolution)."""
    micros = F.timestamp_diff("MICROSECOND", col(start), col(end))
    return micros.cast("double") / F.lit(HOUR_SECONDS * 1e6)


def plus_hours(c: Column | str, hours: Column | float) -> Column:
    amount = hours if isinstance(hours, Column) else F.lit(float(hours))
    return col(c) + F.make_dt_interval(secs=(amount * HOUR_SECONDS).cast("decimal(18,6)"))


def as_ts(value: str) -> Column:
    """Literal time without zone."""
    return F.lit(value).cast("timestamp_ntz")


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def round_binary(c: Column, digits: int) -> Column:
    """Rounding of the stored binary value: 0.575, stored just below, gives 0.57.

    ``round`` works on the shortest decimal text of a double and would give 0.58.
    """
    scale = 10.0**digits
    return F.round(c * scale) / F.lit(scale)


def clamp(c: Column, low: float, high: float) -> Column:
    """Null-preserving clamp (``greatest``/``least`` skip nulls, so keep them out)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))
