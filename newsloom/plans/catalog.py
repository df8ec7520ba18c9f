"""All queries over the driver's tables, one or more for each operator, with their DuckDB equivalents."""

from __future__ import annotations

from newsloom.plans import answering, assembly, evaluation, incremental, ingestion, lakehouse, quality, ranking, records, routing, search, texts  # noqa: F401  (they register queries)
from newsloom.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    """Every registered query."""
    return dict(QUERIES)


def oracle_sql() -> dict:
    """SQL of the queries that DuckDB can express."""
    return dict(ORACLES)
