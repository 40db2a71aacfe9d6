"""Personal data: patterns propose spans, checksums confirm them, context scores them.

Everything is a column expression: regular expressions, Luhn and mod-97 as folds
over digit arrays, context words in a window before the span. No shuffle.

Defined results: a null text counts as empty and has no span; spans of one kind
never overlap and are the leftmost matches; proposals that fail their validator
are dropped without a second try, but for account numbers (see ``_account_numbers``);
repeated rows stay repeated; other columns pass
through unchanged, and the added columns replace columns of the same name.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in output order, their prefilter, pattern, base score and context words.
# The patterns match the same spans as the plain forms in the comments. Possessive
# quantifiers keep the matcher from recursing on long runs, and the look-behind starts
# an e-mail only where a run of its characters starts (or where the last match ended).


@dataclass(frozen=True)
class Kind:
    name: str
    hint: str
    pattern: str
    score: float
    words: tuple[str, ...]


KINDS = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind(
        "email", "@",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        0.9, ("mail", "contact", "write"),
    ),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind(
        "ip", ".",
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        0.6, ("ip", "host", "server", "address"),
    ),
    # [0-9]([\x20-]?[0-9])+
    Kind("card", "", r"[0-9](?:[ -]?[0-9])++", 0.7, ("card", "visa", "credit", "payment")),
    # \+[0-9][\x20().0-9-]+[0-9]
    Kind("phone", "+", r"\+[0-9][ ().0-9-]+[0-9]", 0.6, ("phone", "call", "tel", "mobile")),
    Kind("iban", "", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}", 0.8, ("iban", "account", "bank")),
)
# Characters of an account number by country code (SWIFT registry, and codes in national use).
IBAN_CHARS: dict[int, str] = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GR IT KM MC MG MR SM GQ TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
BASE = ("email", "ip", "card", "phone")
OCTET = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
PREFILTER = {
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[ -]?[0-9]){12}",
    "iban": r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]",
}
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.1

Span = "struct<kind:string,start:int,end:int,value:string,score:double>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """True if the digits of ``value`` pass the Luhn checksum."""
    digit = F.transform(
        F.split(F.reverse(_digits(value)), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            (c.cast("int") * 2) - F.when(c.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(digit, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(value: Column) -> Column:
    """True if an account number passes the mod-97 checksum."""
    packed = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(packed, 5, 100), F.substring(packed, 1, 4))
    number = F.transform(
        F.split(turned, ""),
        lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55),
    )
    rest = F.aggregate(number, F.lit(0), lambda a, n: (a * F.when(n > 9, 100).otherwise(10) + n) % 97)
    return F.length(packed).between(15, 34) & (rest == 1)


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    return {
        "email": F.lit(True),
        "ip": F.forall(F.split(value, r"\."), lambda part: part.rlike(OCTET)),
        "card": n.between(13, 19) & luhn(value),
        "phone": n.between(9, 15),
    }[kind]


def _proposals(text: Column, kind: Kind) -> Column:
    """All matches of one kind with their places, by one pass over the pieces around them."""
    pieces = F.arrays_zip(
        F.split(text, kind.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("hit"),
    )
    empty = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,value:string>>")

    def step(acc, p):
        start = acc["at"] + F.length(p["gap"])
        end = (start + F.length(p["hit"])).cast("int")
        found = F.struct(start.cast("int").alias("start"), end.alias("end"), p["hit"].alias("value"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], found).alias("out"))

    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    return F.aggregate(F.filter(pieces, lambda p: p["hit"].isNotNull()), start, step)["out"]


def _account_numbers(text: Column, kind: Kind) -> Column:
    """Confirmed account numbers, from the left and without overlap.

    Each place that can start one is tried with the length its country code fixes; a
    run as the pattern takes it is tried whole too, where that fails or is unknown.
    """
    # One character a match, so that a number inside of another run is a start as well.
    starts = _proposals(text, replace(kind, pattern=r"[A-Z](?=[A-Z][0-9]{2}(?: ?[A-Z0-9]){11})"))
    fixed = "|".join(
        rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, codes in sorted(IBAN_CHARS.items())
    )
    longest = 34 + 33 - 3  # characters and the spaces between them; none in the first four

    def parts(s):
        near = F.substr(text, s["start"] + 1, F.lit(longest))
        run = F.regexp_extract(near, f"^{kind.pattern}", 0)
        return F.struct(s["start"].alias("start"), run.alias("run"), F.regexp_extract(near, f"^(?:{fixed})", 0).alias("cut"))

    def step(acc, p):
        fresh = p["start"] >= acc["run_end"]
        value = F.when(p["start"] < acc["at"], "").when((p["cut"] != "") & mod97(p["cut"]), p["cut"])
        value = value.when(fresh & mod97(p["run"]), p["run"]).otherwise("")
        end = (p["start"] + F.length(value)).cast("int")
        span = F.struct(p["start"].alias("start"), end.alias("end"), value.alias("value"))
        return F.struct(
            F.when(value != "", end).otherwise(acc["at"]).alias("at"),
            F.when(value != "", end).when(fresh, (p["start"] + F.length(p["run"])).cast("int"))
            .otherwise(acc["run_end"]).alias("run_end"),
            F.when(value != "", F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"),
        )

    empty = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,value:string>>")
    first = F.struct(F.lit(0).alias("at"), F.lit(0).alias("run_end"), empty.alias("out"))
    return F.aggregate(F.transform(starts, parts), first, step)["out"]


def _score(text: Column, kind: Kind, span: Column) -> Column:
    """Base score, raised when a context word of the kind stands shortly before the span."""
    before = F.greatest(span["start"] - CONTEXT_CHARS, F.lit(0))
    near = F.lower(F.substr(text, before + 1, span["start"] - before))
    bonus = F.when(near.rlike("|".join(kind.words)), CONTEXT_BONUS).otherwise(0.0)
    return F.round(F.lit(kind.score) + bonus, 6)


def pii_spans(text: Column) -> Column:
    """Confirmed spans of a text: array of kind, start, end (code points, end exclusive), value, score.

    Ordered by kind as listed in ``KINDS``, then by start. Null text: empty array.
    """
    whole = F.coalesce(text, F.lit(""))
    return F.concat(*[_spans_of(whole, kind) for kind in KINDS])


def _spans_of(whole: Column, kind: Kind) -> Column:
    possible = whole.contains(kind.hint) if kind.hint else F.lit(True)
    if kind.name in PREFILTER:
        possible = possible & whole.rlike(PREFILTER[kind.name])

    def scored(s):
        return F.struct(
            F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            s["value"].alias("value"), _score(whole, kind, s).alias("score"),
        )

    if kind.name == "iban":
        confirmed = _account_numbers(whole, kind)
    else:
        confirmed = F.filter(_proposals(whole, kind), lambda s: _valid(kind.name, s["value"]))
    return F.when(possible, F.transform(confirmed, scored)).otherwise(F.from_json(F.lit("[]"), f"array<{Span}>"))


def find_pii(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """``docs`` with the array column ``into`` of confirmed spans."""
    return docs.withColumn(into, pii_spans(F.col(text)))


def redact(docs: DataFrame, text: str = "text", min_score: float = 0.0) -> DataFrame:
    """Replace every confirmed span by ``<KIND>``; overlapping spans become one.

    Spans are taken by start, a longer one first; a null text stays null.
    """
    spans = F.array_sort(
        F.filter(pii_spans(F.col(text)), lambda s: s["score"] >= min_score),
        lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]),
    )
    body = F.col(text)

    def step(acc, s):
        gap = F.substr(body, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        mark = F.when(s["start"] >= acc["at"], F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise("")
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap, mark).alias("out")
        )

    folded = F.aggregate(
        F.col("_spans"), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
        lambda acc: F.concat(acc["out"], F.substr(body, acc["at"] + 1, F.length(body))),
    )
    clean = F.when(F.size("_spans") > 0, folded).otherwise(body)
    return docs.withColumn("_spans", spans).withColumn(text, clean).drop("_spans")


def digest(docs: DataFrame, kinds: Sequence[str] = BASE) -> DataFrame:
    """Counts and span lists per document, from the column ``pii``."""

    def label(s: Column) -> Column:
        return F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))

    base = F.filter("pii", lambda s: s["kind"].isin(*kinds))

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return docs.select(
        "doc_id", *[count(k) for k in kinds],
        F.sha2(F.array_join(F.transform(base, label), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("pii", label), ",").alias("spans"),
        F.size(F.filter("pii", lambda s: s["score"] >= 0.8)).cast("long").alias("n_confident"),
    )
