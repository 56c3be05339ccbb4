"""The table of registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netquarry.session import utc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(utc(spark), sf_dir)

        run.__doc__ = fn.__doc__
        run.__name__ = fn.__name__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load_all() -> None:
    """Import every module that registers queries."""
    from netquarry.plans import (  # noqa: F401
        case_queries,
        detect_queries,
        ingest_queries,
        join_queries,
        storage_queries,
        stream_queries,
        text_queries,
    )
