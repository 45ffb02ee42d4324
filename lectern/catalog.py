"""All named queries of the library and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import analytics, chunks, guards, listings, pages, questions, search, sheets, sync, text  # noqa: F401 (each registers its queries)
from .plans.registry import ORACLES, QUERIES
from .plans.search import flagship

__all__ = ["flagship", "oracle_sql", "queries"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
