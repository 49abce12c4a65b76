"""The library's own queries: name -> callable and name -> SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with the SQL that gives the same rows."""

    def add(f: Callable) -> Callable:
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add
