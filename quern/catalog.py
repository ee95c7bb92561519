"""Registered queries of the core, each with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.plans import more_queries, recall_queries, session_queries, store_queries  # noqa: F401  they register their queries
from quern.plans import queries as stored

FLAGSHIP = "recall_hybrid"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(stored.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(stored.SQL)
