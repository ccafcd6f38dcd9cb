"""Registered queries: one per operator of the inventory, each paired with an
independent DuckDB statement of the same result where SQL can express it.

Every query reads the driver tables in full (whole tables, whole texts).
Doubles are rounded to 6 digits on both sides; every top-k has a total order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from tessera.plans import q_corpus, q_dist, q_extras, q_generate, q_metrics, q_nextvec, q_patterns, q_stream, q_vectors  # noqa: F401
