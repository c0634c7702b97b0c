"""The named queries of the library and their SQL for other engines."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register f(spark, sf_dir) -> DataFrame; sql is its counterpart, if SQL has one."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def load() -> None:
    from . import added_queries, curation_queries, decision_queries, image_queries, metric_queries, more_queries, relational_queries  # noqa: F401
