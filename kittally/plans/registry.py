"""Named queries over the benchmark tables, with their SQL where a second engine can run it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..session import own_session

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        @wraps(fn)
        def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(own_session(spark), sf_dir)

        QUERIES[name] = sized
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
