"""All fleet queries by name, bound to the test tables, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators import analysis, chunk_queries, cleaning, enrichment, features, model_queries, reports  # noqa: F401
from .plans import analytics, insights, packaged, stated  # noqa: F401
from .plans.dialect import REGISTRY, Op
from .sources import table_queries
from .sources.views import fleet_views, oracle_ctes
from .streaming import queries as stream_queries


def run(op: Op, spark: SparkSession, sf_dir: str) -> DataFrame:
    return op(**fleet_views(spark, sf_dir, op.inputs), **op.given)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {key: (lambda spark, sf_dir, op=op: run(op, spark, sf_dir)) for key, op in REGISTRY.items()} | stream_queries.queries() | model_queries.queries() | table_queries.queries() | chunk_queries.queries()


def oracle_sql() -> dict[str, str]:
    return {key: op.oracle(oracle_ctes(op.inputs)) for key, op in REGISTRY.items() if op.has_oracle} | stream_queries.oracle_sql() | model_queries.oracle_sql() | table_queries.oracle_sql() | chunk_queries.oracle_sql() | stated.oracle_sql()
