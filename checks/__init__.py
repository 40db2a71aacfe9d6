"""Registered queries with their SQL twins; importing a module registers its queries."""
from checks import (  # noqa: F401
    catalog_checks,
    chart_checks,
    column_checks,
    engagement_checks,
    ingest_checks,
    quality_checks,
    stream_checks,
)
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
