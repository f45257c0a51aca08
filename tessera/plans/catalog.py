"""All core queries with the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import analysis_queries, context_queries, hierarchy_queries, retrieval_queries, store_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (retrieval_queries, store_queries, analysis_queries, hierarchy_queries, context_queries)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_queries.bm25_search(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.SQL.items()}
