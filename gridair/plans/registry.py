"""Registry of runnable queries, each with the SQL that checks it where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from gridair.adapters import Tables, oracle_text


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` as query ``name``; ``sql`` is its check over the same tables."""
    def wrap(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, oracle_text(sql) if sql else None)
        return fn
    return wrap


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: (lambda spark, folder, q=q: q.run(Tables(spark, folder))) for n, q in REGISTRY.items()}


def oracles() -> dict[str, str]:
    return {n: q.sql for n, q in REGISTRY.items() if q.sql}
