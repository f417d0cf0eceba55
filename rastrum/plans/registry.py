"""Query registry: each entry is a Spark job and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import Tables, with_shapes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, shapes: str = "", sql: str | None = None):
    """Register ``fn(tables)`` under ``name``; ``sql`` may use the named shapes as CTEs.

    ``sql`` that defines further CTEs starts with a comma: ``", x AS (...) SELECT ..."``.
    """
    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, root: fn(Tables(spark, root))
        if sql is not None:
            head = with_shapes(*shapes.split()) if shapes else ""
            ORACLES[name] = f"{head}\n{sql.strip()}"
        return fn
    return add
