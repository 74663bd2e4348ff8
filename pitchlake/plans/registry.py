"""All registered queries of the analytics engine and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pitchlake.plans import eda_queries, feature_queries, model_queries, source_queries

_PARTS = (source_queries, feature_queries, eda_queries, model_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_queries.w1_pass_windows(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
