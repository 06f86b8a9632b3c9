"""Registry of the library's queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query (spark, sf_dir) under a name, with its SQL."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the clusters that the grouping pipeline finds."""
    return QUERIES["pipeline_grouping_sizes"](spark, sf_dir)


from pairweave.plans import queries_pairs, queries_rows, queries_training  # noqa: E402, F401
