"""Queries by name, and their SQL. Each applies an operator to whole tables derived from the given ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pathweave.plans import page_queries, routing_queries, served_queries, source_queries, study_queries, trial_queries

_MODULES = (routing_queries, study_queries, trial_queries, served_queries, source_queries, page_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many announced pairs are valid, unknown, or invalid by each kind."""
    return queries()["validity_counts"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for m in _MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
