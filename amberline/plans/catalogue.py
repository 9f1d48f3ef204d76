"""The query catalogue over the driver's tables, and each query in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from amberline.plans import decision_queries, profile_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**profile_queries.QUERIES, **decision_queries.QUERIES, **text_queries.QUERIES}
ORACLE_SQL: dict[str, str] = {**profile_queries.SQL, **decision_queries.SQL, **text_queries.SQL}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_queries.answered_questions(spark, sf_dir)
