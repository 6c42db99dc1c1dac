"""Queries of the engine over the test tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}

_MODULES = ("text_queries", "record_queries", "relational_queries", "retrieval_queries", "index_queries", "state_queries", "stream_queries")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with the SQL that gives the same rows."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            TWINS[name] = sql
        return run

    return register


def load() -> None:
    for module in _MODULES:
        importlib.import_module(f"tarnwell.registry.{module}")
