"""Registry: query name -> (Spark builder, DuckDB oracle text or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from threadmill.plans import (  # noqa: F401
        q_clean,
        q_labels,
        q_store,
        q_vocab,
        q_encode,
        q_model,
        q_io,
        q_stream,
    )
