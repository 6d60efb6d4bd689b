"""Seams for user-supplied models: batches of rows to answers, with errors as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def batch_infer(tasks: DataFrame, generate: Callable[[list[dict]], list[str]], key: str, batch: int = 32, done: DataFrame | None = None, sort_by: str | None = None) -> DataFrame:
    """(key, raw_output, error) of every task that isn't done. ``generate`` gets rows as dicts and must give as many
    answers; a batch that fails is tried row by row, and a row that fails keeps its error."""
    if done is not None:
        tasks = tasks.join(done.select(key).distinct(), key, "left_anti")
    if sort_by:
        tasks = tasks.sortWithinPartitions(sort_by)
    kind = dict(tasks.dtypes)[key]

    def answer(rows: list[dict]) -> list[tuple[str | None, str | None]]:
        try:
            found = generate(rows)
            if len(found) != len(rows):
                raise RuntimeError(f"{len(found)} answers to {len(rows)} tasks")
            return [(str(x), None) for x in found]
        except Exception as e:  # noqa: BLE001  any failure of the model becomes rows
            if len(rows) == 1:
                return [(None, f"{type(e).__name__}: {e}")]
            return [x for r in rows for x in answer([r])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = pdf.to_dict("records")
            out = [x for at in range(0, len(rows), batch) for x in answer(rows[at : at + batch])]
            yield pd.DataFrame({key: pdf[key], "raw_output": [x[0] for x in out], "error": [x[1] for x in out]})

    return tasks.mapInPandas(run, f"`{key}` {kind}, raw_output string, error string")


def registry_infer(tasks: DataFrame, registry: dict[str, Callable[[list[dict]], list[str]]], name: str, key: str, **options) -> DataFrame:
    """As :func:`batch_infer`, by the name of a registered function."""
    if name not in registry:
        raise KeyError(f"{name} isn't one of {sorted(registry)}")
    return batch_infer(tasks, registry[name], key, **options)


def cascade_classify(df: DataFrame, stages: list[tuple[str, Column, Column]], default: str = "-") -> DataFrame:
    """Stage by stage (column, gate, label): rows outside a stage's gate get the default; a gate may use the columns
    of the stages before it. A null label is ERROR."""
    for name, gate, label in stages:
        df = df.withColumn(name, F.when(F.coalesce(gate, F.lit(False)), F.coalesce(label, F.lit("ERROR"))).otherwise(default))
    return df


def row_label_udf(df: DataFrame, label: Callable[[pd.DataFrame], pd.DataFrame], columns: list[str], schema: str, name: str = "labels") -> DataFrame:
    """``df`` with a struct column that a caller's function of whole Arrow batches gives, row for row, from ``columns``.

    The seam for rules that built-in expressions can't state; where they can, they are faster."""

    @F.pandas_udf(schema)
    def rows(batch: pd.DataFrame) -> pd.DataFrame:
        return label(batch).reset_index(drop=True)

    return df.withColumn(name, rows(F.struct(*columns)))


def group_collapse(df: DataFrame, by: list[str], columns: dict[str, Column] | None = None, collapse: Callable[[pd.DataFrame], dict] | None = None, schema: str = "") -> DataFrame:
    """One row per group: by aggregate columns, or else by a caller's function of the group's rows, which must then be
    few enough for a task."""
    if columns is not None:
        return df.groupBy(*by).agg(*[c.alias(n) for n, c in columns.items()])
    return df.groupBy(*by).applyInPandas(lambda key, rows: pd.DataFrame([{**dict(zip(by, key, strict=True)), **collapse(rows)}]), schema)
