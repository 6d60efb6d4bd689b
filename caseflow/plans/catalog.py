"""All registered queries with their DuckDB counterparts, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import files, labels, more, records, reports, shapes, summaries, tables

MODULES: tuple = (tables, labels, reports, shapes, more, files, records, summaries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
