"""Audit of how filters interact: what each removes, in any order, and its Shapley share.

One pass reads the whole texts and gives every document the set of filters it fails
(a bit mask). Documents are counted by part and mask; from these counts the removals
of all coalitions of filters are tabulated (with five filters 32 numbers a part: the
documents that fail at least one filter of the coalition). Everything else is read off
that table: the documents removed at a step are the difference of two coalitions.

The Shapley values solve a least-squares problem: of all additive functions with the
same total over all filters (the efficiency constraint), the one nearest to the table,
coalitions weighted by the Shapley kernel. The solution is linear in the table, so its
normal equations are solved once, in rationals, for every unit table; times the number
of orders the solution has whole coefficients, and Spark applies them to each part.

Copies: a row fails that filter if a row with a smaller doc_id has the same text
anywhere. Equal texts fail the same other filters, so they are counted by text, part
and label before anything is joined, and a text with very many copies is a few rows.

Defined results: a null text is an empty one; a null part is the empty text's part; a
row without doc_id neither is nor makes a copy; rows with one doc_id aren't copies of
each other; a label holds if any label row of the id says 1; an empty table gives no
row. Other columns play no part.
"""
from __future__ import annotations

import json
from collections.abc import Mapping
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartlake.operators.skew import salted_join
from chartlake.session import materialize

#: Words are runs of characters other than space and control white space.
SPACE = r"[\x20\x09-\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions A to D; ``text`` is not null."""
    words = F.array_remove(F.split(text, SPACE), "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def solve(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """Exact solution of a regular system for several right sides (columns)."""
    n = len(matrix)
    rows = [[*a, *b] for a, b in zip(matrix, right)]
    for i in range(n):
        pivot = next(r for r in range(i, n) if rows[r][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(n):
            if r != i and rows[r][i]:
                factor = rows[r][i]
                rows[r] = [x - factor * y for x, y in zip(rows[r], rows[i])]
    return [row[n:] for row in rows]


def shapley_coefficients(n: int) -> list[list[int]]:
    """For each of ``n`` players the factors of the ``2**n`` coalition values.

    Their sum of products is the Shapley value times ``n!``. Minimized is the sum over
    coalitions S, neither empty nor full, of w(S) (v(S) - sum of x over S)**2 with
    w(S) = (n - 1) / (comb(n, |S|) |S| (n - |S|)), under sum of x = v(all).
    """
    full = (1 << n) - 1
    if n == 1:
        return [[0, 1]]
    inside = [[(s >> i) & 1 for i in range(n)] for s in range(full + 1)]
    weight = [Fraction(n - 1, comb(n, k) * k * (n - k)) if 0 < (k := sum(m)) < n else Fraction(0) for m in inside]
    # Normal equations with a multiplier for the constraint, one right side per coalition.
    matrix = [[sum(w * m[i] * m[j] for w, m in zip(weight, inside)) for j in range(n)] + [Fraction(1)] for i in range(n)]
    matrix.append([Fraction(1)] * n + [Fraction(0)])
    right = [[weight[s] * inside[s][i] for s in range(full + 1)] for i in range(n)]
    right.append([Fraction(int(s == full)) for s in range(full + 1)])
    solution = [[x * factorial(n) for x in row] for row in solve(matrix, right)[:n]]
    assert all(x.denominator == 1 for row in solution for x in row)
    return [[int(x) for x in row] for row in solution]


def failure_counts(
    docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column], part: Column, copies: bool = True
) -> DataFrame:
    """``part``, ``mask`` (bit i: fails filter i) and the counts ``n``, ``good``, ``toxic``.

    ``filters`` are conditions on the column ``text`` (null texts are empty); with
    ``copies`` the filter after them is that of copies.
    """
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"),
    )
    mask = F.lit(0)
    for i, condition in enumerate(filters.values()):
        mask = mask + F.when(condition, 1 << i).otherwise(0)
    whole = docs.select("doc_id", F.coalesce(part, F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    digest = F.unhex(F.sha2("text", 256)) if copies else F.lit(None).cast("binary")
    narrow = materialize(whole.select("doc_id", "part", mask.cast("int").alias("mask"), digest.alias("digest")))
    marked = salted_join(narrow, known, ["doc_id"], "left").select(
        "doc_id", "part", "mask", "digest", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")
    )
    if not copies:
        counts = marked.groupBy("part", "mask").agg(
            F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")
        )
        return counts
    # One row per text, part and label, whatever the number of copies: its rows, and how
    # many of them have the smallest id here. Only these can be no copy.
    keys = ["digest", "part", "mask", "good", "toxic"]
    per_id = marked.groupBy(*keys, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    groups = per_id.groupBy(*keys).agg(
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
        F.sum("n").alias("n"),
    )
    groups = materialize(groups)
    first = groups.groupBy("digest").agg(F.min("least.doc_id").alias("first"))
    held = groups.join(first, "digest")
    own = F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0) + F.col("nameless")
    copied = 1 << len(filters)
    split = held.select(
        "part", "good", "toxic",
        F.explode(F.array(
            F.struct(F.col("mask"), own.alias("n")),
            F.struct((F.col("mask") + copied).alias("mask"), (F.col("n") - own).alias("n")),
        )).alias("s"),
    )
    return split.groupBy("part", F.col("s.mask").alias("mask")).agg(
        F.sum("s.n").alias("n"), F.sum(F.col("good") * F.col("s.n")).alias("good"),
        F.sum(F.col("toxic") * F.col("s.n")).alias("toxic"),
    )


def coalition_table(counts: DataFrame, n: int) -> DataFrame:
    """One row per part: rows ``total`` and by coalition the removals ``v``, ``good``, ``toxic`` (arrays)."""

    def removed(of: str) -> Column:
        return F.array(*[
            F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) != 0, F.col(of)).otherwise(0)) for s in range(1 << n)
        ]).cast("array<long>")

    return counts.groupBy("part").agg(
        F.sum("n").cast("long").alias("total"), removed("n").alias("v"), removed("good").alias("good"), removed("toxic").alias("toxic")
    )


def interaction_audit(counts: DataFrame, names: str) -> DataFrame:
    """Per part, order of the filters and step: the counts of ``op12`` (see module).

    ``names`` has one letter a filter, in the order of the mask's bits.
    """
    n = len(names)
    full = (1 << n) - 1
    steps = []
    for order in permutations(range(n)):
        before = 0
        for at, i in enumerate(order):
            steps.append({"o": "".join(names[j] for j in order), "t": at + 1, "i": i, "b": before})
            before |= 1 << i
    plan = F.from_json(F.lit(json.dumps(steps)), "array<struct<o:string,t:int,i:int,b:int>>")
    shares = F.array(*[
        sum((F.col("v")[s] * c for s, c in enumerate(row) if c), F.lit(0).cast("long"))
        for row in shapley_coefficients(n)
    ])
    table = coalition_table(counts, n).withColumn("shares", shares)
    each = table.withColumn("s", F.explode(plan))
    bit = F.call_function("shiftleft", F.lit(1), F.col("s.i"))
    each = each.withColumn("after", F.col("s.b").bitwiseOR(bit)).withColumn("others", F.lit(full) - bit)

    def gained(values: str) -> Column:
        return F.get(F.col(values), F.col("after")) - F.get(F.col(values), F.col("s.b"))

    return each.select(
        "part", F.col("s.o").alias("filter_order"), F.col("s.t").alias("step"),
        (F.col("total") - F.get("v", F.col("after"))).alias("kept"),
        gained("v").alias("removed"),
        (F.get("v", bit) - gained("v")).alias("redundant"),
        (F.get("v", F.lit(full)) - F.get("v", F.col("others"))).alias("unique_fails"),
        gained("good").alias("good_lost"),
        gained("toxic").alias("toxic_lost"),
        F.get("shares", F.col("s.i")).alias("shapley"),
    )
