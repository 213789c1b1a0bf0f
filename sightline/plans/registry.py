"""Registry of queries: callable, SQL twin and the operator ids each one covers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}


def register(name: str, ids: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Add a query under ``name``; ``ids`` lists the operators it exercises."""

    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        COVERS[name] = tuple(ids.split())
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def r6(col: str | Column, name: str | None = None) -> Column:
    """Round to 6 decimals for comparison across engines."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, 6).alias(name or (col if isinstance(col, str) else "value"))


def big(col: str | Column, name: str | None = None) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("bigint").alias(name or col)


def joined(col: str | Column, name: str) -> Column:
    """Array -> comma-separated text, for comparison across engines."""
    c = F.col(col) if isinstance(col, str) else col
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(name)
