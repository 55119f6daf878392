"""Registered queries: one Spark callable per operator and, where SQL can say it, the same result in SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketloom.catalog.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_BODIES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a callable; ``sql`` may use the shared views by name."""

    def wrap(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = fn
        if sql is not None:
            _BODIES[key] = sql
        return fn

    return wrap


def load() -> None:
    """Import all query modules, then expand the shared views, whose definitions are spread over them."""
    from marketloom.catalog import aggregates, filters, frames, functions, jobs, joins, momentum  # noqa: F401
    from marketloom.catalog import scores, screeners, sorting, sources, streams, valuation  # noqa: F401

    for key, body in _BODIES.items():
        if key not in ORACLES:
            ORACLES[key] = with_views(body)
