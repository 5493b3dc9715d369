"""The queries of the engine's own operators and the DuckDB statements that check them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexloom.plans import correction, evaluation, matching, pairs, reports, texts, typo_plans

MODULES = [evaluation, texts, typo_plans, pairs, matching, correction, reports]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
