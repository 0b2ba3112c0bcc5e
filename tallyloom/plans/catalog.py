"""Register a query together with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .tables import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None, uses: str = ""):
    """Decorate ``f(tables) -> DataFrame``; ``uses`` names the fixture views ``sql`` reads."""

    def register(f: Callable[[Tables], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLES[key] = with_views(sql, uses.split())
        return f

    return register
