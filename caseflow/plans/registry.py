"""Binding of operators to the given tables: a query takes :class:`Tables` and has a DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """The Parquet tables of a folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


class Registry:
    """Queries of one module, by key, with the SQL of those that SQL can express."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def query(self, sql: str | None = None, key: str | None = None):
        def add(run: Callable[[Tables], DataFrame]):
            name = key or run.__name__
            self.queries[name] = lambda spark, sf_dir: run(Tables(spark, sf_dir))
            if sql:
                self.oracle[name] = sql
            return run

        return add
