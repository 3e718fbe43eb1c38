"""Queries over the driver's tables, one for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.plans import candidate_queries, file_queries, message_queries, pattern_queries, regional_queries, repair_queries, rule_queries, source_queries, split_queries, text_queries  # noqa: F401  they register themselves
from textloom.plans.views import ORACLE, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
