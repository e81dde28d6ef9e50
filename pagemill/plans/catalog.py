"""All core queries by name, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagemill.plans import data_queries, fold_queries, join_queries, layout_queries, page_queries, source_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (data_queries, layout_queries, join_queries, page_queries, fold_queries, source_queries)


def queries() -> dict[str, Query]:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
