"""Registry of named queries: a Spark callable and, where possible, checking SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a ``(spark, folder) -> DataFrame`` function under its own name."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        key = name or fn.__name__
        if key in REGISTRY:
            raise ValueError(f"query {key} is registered twice")
        REGISTRY[key] = Query(key, fn, sql)
        return fn

    return register
