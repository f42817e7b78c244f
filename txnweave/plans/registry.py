"""All queries of this package but those of the training-data subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import dataset_queries, extraction_queries, io_queries, more_queries, set_queries, table_queries

ALL = extraction_queries.QUERIES | dataset_queries.QUERIES | io_queries.QUERIES | more_queries.QUERIES | set_queries.QUERIES | table_queries.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for name, (q, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
