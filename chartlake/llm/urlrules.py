"""URL filters: allow and block rules on hosts and path prefixes.

A rule fits a host and all its subdomains where the path starts with the rule's path.
A URL becomes the expressions that could be a rule: every host suffix with every path
prefix, of the numbers of labels and characters that rules have. Expressions meet
rules in an equi-join on the first 32 bits of their SHA-256; the full digests confirm a
match. Of the rules that fit a URL the longest text wins, then the longer host.

DataFrame functions only. The verdict depends on host and path alone, so distinct URLs
are judged and a URL with very many pages is one row. Rules are broadcast if counted
few and short; else hot expressions (``org/``) are salted.

Defined results: a null URL, or one without ``://``, has empty host and path, and is
judged as these; hosts lose capitals A-Z only, paths keep theirs; ports and user names
are part of the host; a URL that no rule fits gets the verdict ``otherwise`` and no
rule; of equal rules a block wins; rules with a null field and rows of other verdicts
don't count; rows keep their number; other columns pass through, and added columns
replace columns of the same name. An empty table gives no row.
"""
from __future__ import annotations

import json
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartlake.operators.skew import salted_join
from chartlake.session import materialize

#: Rules and bytes of rule texts up to which rules are broadcast.
BROADCAST_RULES = 200_000
BROADCAST_BYTES = 32 << 20
#: Hexadecimal digits of the joined hash prefix.
PREFIX_DIGITS = 8
ADDED = ("host", "path", "rule", "verdict")


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*+", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + F.lit(1)), "^[^?#]*+", 0)
    return _lower(host), path


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\.", -1))


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


def prepared_rules(rules: DataFrame) -> DataFrame:
    """Distinct rules with ``labels``, ``chars``, ``digest`` and ``prefix``."""
    usable = rules.where("host is not null and path is not null and verdict in ('allow', 'block')")
    distinct = usable.groupBy(_lower(F.col("host")).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    digest = _digest(F.concat("host", "path"))
    return distinct.select(
        F.concat("host", "path").alias("rule"), "verdict", _labels(F.col("host")).alias("labels"),
        F.length("path").alias("chars"), digest.alias("digest"), F.substring(digest, 1, PREFIX_DIGITS).alias("prefix"),
    )


def expressions(host: Column, path: Column, shapes: Column) -> Column:
    """Host suffix and path prefix of every shape (``labels``, ``chars``) that the URL is long enough for."""
    possible = F.filter(shapes, lambda s: (s["labels"] <= _labels(host)) & (s["chars"] <= F.length(path)))

    def text(s):
        suffix = F.call_function("substring_index", host, F.lit("."), -s["labels"])
        return F.struct(s["labels"].alias("labels"), s["chars"].alias("chars"), F.concat(suffix, F.left(path, s["chars"])).alias("text"))

    return F.transform(possible, text)


def judge_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow", broadcast_rules: int = BROADCAST_RULES
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (its text, or null) and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict`` (allow or block).
    """
    known = materialize(prepared_rules(rules))
    # One row for the driver: how large the rules are, and their shapes. Shapes are few:
    # numbers of labels times path lengths that occur.
    about = known.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("rule")), F.lit(0)).alias("bytes"),
        F.array_sort(F.collect_set(F.struct("labels", "chars"))).alias("shapes"),
    ).first()
    host, path = url_parts(F.col(url))
    parsed = pages.withColumns({"host": host, "path": path}).drop("rule", "verdict")
    kept = [c for c in parsed.columns if c not in ("host", "path")]
    if not about["n"]:
        return parsed.select(*kept, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    shapes = json.dumps([{"labels": s["labels"], "chars": s["chars"]} for s in about["shapes"]])
    shapes = F.from_json(F.lit(shapes), "array<struct<labels:int,chars:int>>")
    urls = parsed.select("host", "path").distinct()
    each = urls.select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), shapes)).alias("e"))
    each = each.select("host", "path", "e.labels", "e.chars", _digest(F.col("e.text")).alias("own"))
    each = each.withColumn("prefix", F.substring("own", 1, PREFIX_DIGITS))
    table = known.withColumnRenamed("labels", "_labels").withColumnRenamed("chars", "_chars")
    if about["n"] <= broadcast_rules and about["bytes"] <= BROADCAST_BYTES:
        met = each.join(F.broadcast(table), "prefix")
    else:
        met = salted_join(materialize(each), table, ["prefix"])
    # The same text can be cut into host and path in one way only: by the shape.
    fits = met.where("own = digest and labels = _labels and chars = _chars")
    strength = F.struct(F.length("rule"), F.col("labels"), F.col("chars"))
    won = fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), strength).alias("won"))
    out = salted_join(parsed, materialize(won), ["host", "path"], "left", counted=parsed.select("host", "path"))
    return out.select(
        *kept, "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(otherwise)).alias("verdict")
    )
