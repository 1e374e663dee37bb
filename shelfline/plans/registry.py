"""Registry of named queries, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def add(name: str, query: Query, check: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query registered twice: {name}")
    QUERIES[name] = query
    if check is not None:
        CHECKS[name] = check


def load_all() -> None:
    """Imports the modules that register queries."""
    from shelfline.plans import (  # noqa: F401
        consistency_queries,
        outbox_queries,
        report_queries,
        search_queries,
    )
