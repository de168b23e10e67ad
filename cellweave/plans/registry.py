"""Named queries with, where SQL can express them, the equivalent portable statement."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from .tables import Tables, sql_with

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, needs: Sequence[str] = (), sql: str | None = None):
    """Register ``build(tables) -> DataFrame`` under a name, with its optional SQL."""
    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, path: build(Tables(spark, path))
        if sql is not None:
            ORACLES[name] = sql_with(list(needs), sql)
        return build
    return register
