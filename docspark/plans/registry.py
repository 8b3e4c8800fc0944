"""Registered queries of the library and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from docspark.plans.views import oracle

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `f(spark, sf_dir)`; `sql` may name the shaped views."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = oracle(sql)
        return f

    return add


def load() -> None:
    """Import the modules that register queries."""
    from docspark.plans import corpus, documents, highlights, retrieval, sections, summaries, texts, usage  # noqa: F401
