"""The named queries of the engine and the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codexa.plans import cleaning_queries, record_queries, structure_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]
_PARTS = (text_queries, structure_queries, record_queries, cleaning_queries)


def queries() -> dict[str, Query]:
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items() if sql}
