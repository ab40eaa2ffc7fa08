"""All queries of the core with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import q_evaluate, q_more, q_recall, q_stores, q_stream, q_tasks, q_text  # noqa: F401
from tidemark.plans.registry import ORACLE, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return QUERIES["t1_token_budget_recall"](spark, d)
