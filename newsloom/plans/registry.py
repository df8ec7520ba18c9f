"""Where queries over the driver's tables are registered, each with its DuckDB equivalent if SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame under its own name or the one given."""

    def register(f: Callable) -> Callable:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"two queries are named {key}")
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return register
