"""Registry of (query, SQL twin) pairs.

The SQL of a twin may use the domain views of ``checks.views``; they are put in
front of it as common table expressions.
"""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chartlake.sources.driver import Domain
from checks.views import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


_DOMAINS: dict[tuple[str, str], Domain] = {}


def domain(spark: SparkSession, folder: str) -> Domain:
    """Domain of a folder, shared by the queries of one application with its stored tables."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _DOMAINS:
        _DOMAINS[key] = Domain(spark, folder)
    return _DOMAINS[key]


def with_views(sql: str) -> str:
    """Prefix the used domain views, dependencies first."""
    ordered: list[str] = []

    def need(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in ordered and re.search(rf"\b{name}\b", text):
                need(body)
                if name not in ordered:
                    ordered.append(name)

    need(sql)
    if not ordered:
        return sql
    heads = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in ordered)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {heads},\n{body[5:]}"
    return f"WITH {heads}\n{body}"


def check(name: str, sql: str | None = None):
    """Register ``fn(domain) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Domain], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(domain(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register
