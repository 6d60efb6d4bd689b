"""Scores of classes: softmax, priors, bias by matching marginals, and probes on embeddings."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import group_kfold


def softmax_rows(long: DataFrame, row: str, score: str) -> DataFrame:
    """``p`` of each (row, class) from its score, stable for large scores."""
    w = Window.partitionBy(row)
    e = long.withColumn("_e", F.exp(F.col(score) - F.max(score).over(w)))
    return e.withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def argmax_label(classes: list[str], columns: list[str]) -> Column:
    """Class of the largest score; the first on ties."""
    best = F.greatest(*[F.col(c) for c in columns])
    out = None
    for name, c in zip(classes, columns, strict=True):
        out = F.when(F.col(c) == best, name) if out is None else out.when(F.col(c) == best, name)
    return out


def prior_correction(long: DataFrame, row: str, label: str, score: str) -> DataFrame:
    """Scores less the log of their class's mean softmax."""
    p = softmax_rows(long, row, score)
    mean = p.groupBy(label).agg(F.avg("p").alias("_m"))
    return p.join(F.broadcast(mean), label).withColumn("corrected", F.col(score) - F.log(F.col("_m") + 1e-12)).drop("_m", "p")


def marginal_matching(long: DataFrame, row: str, label: str, score: str, rounds: int = 500, damping: float = 0.5, tolerance: float = 1e-6) -> tuple[DataFrame, dict[str, float]]:
    """Scores with a bias per class such that the mean softmax is uniform; what a round gathers is one number a class."""
    labels = sorted(r[0] for r in long.select(label).distinct().collect())
    bias = dict.fromkeys(labels, 0.0)
    wide = long.groupBy(row).agg(*[F.max(F.when(F.col(label) == k, F.col(score))).alias(f"_{i}") for i, k in enumerate(labels)]).persist()
    for _ in range(rounds):
        shifted = [F.col(f"_{i}") - F.lit(bias[k]) for i, k in enumerate(labels)]
        top = F.greatest(*shifted) if len(shifted) > 1 else shifted[0]
        parts = [F.exp(s - top) for s in shifted]
        total = sum(parts[1:], parts[0])
        means = wide.agg(*[F.avg(p / total).alias(f"m{i}") for i, p in enumerate(parts)]).first()
        step = {k: damping * (math.log(means[f"m{i}"] + 1e-12) + math.log(len(labels))) for i, k in enumerate(labels)}
        bias = {k: bias[k] + step[k] for k in labels}
        if max(map(abs, step.values()), default=0.0) < tolerance:
            break
    wide.unpersist()
    table = F.create_map(*[x for k, v in bias.items() for x in (F.lit(k), F.lit(v))])
    return long.withColumn("matched", F.col(score) - F.element_at(table, F.col(label))), bias


#: Newton steps of a fit: passes over the rows, besides one for means and deviations.
STEPS = 8


def out_of_fold(df: DataFrame, features: str, label: str, fold: str, tasks: dict[str, list], reg: float = 0.01, standardise: bool = True, steps: int = STEPS) -> DataFrame:
    """``df`` with ``task`` and ``predicted``: for each task (name -> its labels, over rows of those) and each fold, the
    label that a multinomial logistic regression on the other folds gives.

    All tasks and folds are fitted together by iteratively reweighted least squares: a pass sums, for every model, the
    gradient and the normal matrix over its rows, in parts that are added up in Spark, and ``steps`` such passes are
    made. The driver holds numbers of models only: (labels x features) squared for each. The penalty is ``reg`` / 2 times
    the squared weights (of standardised features, if asked for; intercepts are free), and the loss is a mean, so results
    don't depend on how rows lie. Rows without features or label are predicted or left out as their task has them.
    """
    spark, names = df.sparkSession, sorted(tasks)
    x = df.withColumns({"_x": F.col(features).cast("array<double>"), "_k": F.col(label).cast("string"), "_fold": F.col(fold).cast("int")})
    given = x.where(F.col("_x").isNotNull() & F.col("_k").isNotNull()).select("_x", "_k", "_fold")
    folds = sorted(r[0] for r in given.select("_fold").distinct().collect())
    classes = {name: [str(c) for c in tasks[name]] for name in names}
    context = spark.sparkContext
    totals = _moments(_summed(given, _moment_sums(classes)), names, folds)
    models = {key: _Model(n, mean, dev if standardise else np.ones_like(dev), len(classes[key[0]])) for key, (n, mean, dev) in totals.items() if n}
    for _ in range(steps if models else 0):
        shared = context.broadcast(models)
        for key, sums in _summed(given, _newton_sums(classes, shared)).items():
            models[key].step(sums, reg)
    shared = context.broadcast(models)

    @F.pandas_udf("array<struct<task:string,predicted:string>>")
    def predict(rows: pd.Series, labels: pd.Series, fold: pd.Series) -> pd.Series:
        out: list[list] = [[] for _ in rows]
        known = [k for k, r in enumerate(rows) if r is not None]
        for name in names:
            for f in set(fold.iloc[known]):
                at = [k for k in known if fold.iloc[k] == f and labels.iloc[k] in classes[name]]
                model = shared.value.get((name, f))
                if at and model:
                    best = model.scores(np.stack([rows.iloc[k] for k in at])).argmax(1)
                    for k, b in zip(at, best, strict=True):
                        out[k].append({"task": name, "predicted": classes[name][b]})
        return pd.Series(out)

    found = x.withColumn("_p", F.explode(predict("_x", "_k", "_fold")))
    return found.select(*df.columns, F.col("_p.task").alias("task"), F.col("_p.predicted").cast(df.schema[label].dataType).alias("predicted"))


class _Model:
    """Weights (labels x features, then the intercept) of one task without one fold, on standardised features."""

    def __init__(self, n: int, mean: np.ndarray, dev: np.ndarray, labels: int) -> None:
        self.n, self.mean, self.dev = n, mean, np.where(dev > 0, dev, 1.0)
        self.weights = np.zeros((labels, len(mean) + 1))

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([(x - self.mean) / self.dev, np.ones((len(x), 1))])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.inputs(x) @ self.weights.T

    def sums(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Gradient and normal matrix of the loss over rows, flat."""
        z, s = self.inputs(x), self.scores(x)
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        k, d = self.weights.shape
        gradient = (p - np.eye(k)[y]).T @ z
        normal = np.empty((k, d, k, d))
        for i in range(k):
            for j in range(i, k):
                normal[i, :, j, :] = (z * (p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ z
                normal[j, :, i, :] = normal[i, :, j, :]
        return np.concatenate([gradient.ravel(), normal.ravel()])

    def step(self, sums: np.ndarray, reg: float) -> None:
        size = self.weights.size
        penalty = np.ones_like(self.weights) * reg
        penalty[:, -1] = 0.0
        gradient = sums[:size] / self.n + (penalty * self.weights).ravel()
        normal = sums[size:].reshape(size, size) / self.n + np.diag(penalty.ravel())
        # intercepts may be shifted together without any effect: the least change is taken
        move = np.linalg.lstsq(normal, gradient, rcond=1e-12)[0]
        self.weights -= (move * min(1.0, 4.0 / max(1e-12, np.abs(move).max()))).reshape(self.weights.shape)


#: Tasks that the parts of a model's sums are added up in first.
SUM_TASKS = 16


def _summed(rows: DataFrame, part) -> dict[tuple[str, int], np.ndarray]:
    """Sums by (task, fold) of the flat arrays that ``part`` yields for each partition, added up in two rounds."""

    def add(batch: pa.Table) -> pa.Table:
        total = np.sum([np.asarray(v) for v in batch.column("v").to_pylist()], axis=0)
        return pa.table({"task": batch.column("task").slice(0, 1), "fold": batch.column("fold").slice(0, 1), "v": pa.array([total.tolist()], pa.list_(pa.float64()))})

    schema = "task string, fold int, v array<double>"
    parts = rows.mapInArrow(part, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SUM_TASKS)))
    first = parts.groupBy("task", "fold", "salt").applyInArrow(add, schema)
    return {(r.task, r.fold): np.array(r.v) for r in first.groupBy("task", "fold").applyInArrow(add, schema).collect()}


def _by_model(classes: dict[str, list[str]], batches: Iterator[pa.RecordBatch], run) -> Iterator[pa.RecordBatch]:
    """Add up ``run(task, fold of the rows, features, label numbers)`` -> {fold of the model: array} over a partition."""
    total: dict[tuple[str, int], np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        x, labels, fold = np.array(batch.column(0).to_pylist(), float), np.array(batch.column(1).to_pylist(), object), batch.column(2).to_numpy()
        for name, own in classes.items():
            number = {c: k for k, c in enumerate(own)}
            y = np.array([number.get(v, -1) for v in labels])
            for f in np.unique(fold[y >= 0]):
                at = (y >= 0) & (fold == f)
                for g, v in run(name, int(f), x[at], y[at]).items():
                    total[name, g] = total[name, g] + v if (name, g) in total else v
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in total]), pa.array([f for _, f in total], pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["task", "fold", "v"])


def _moment_sums(classes: dict[str, list[str]]):
    run = lambda name, f, x, y: {f: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])}
    return lambda batches: _by_model(classes, batches, run)


def _moments(sums: dict[tuple[str, int], np.ndarray], names: list[str], folds: list[int]) -> dict[tuple[str, int], tuple[int, np.ndarray, np.ndarray]]:
    """(rows, means, deviations) of each model's rows: those of its task outside its fold."""
    out = {}
    for name in names:
        for f in folds:
            rest = [v for (t, g), v in sums.items() if t == name and g != f]
            if rest:
                v = np.sum(rest, axis=0)
                n, d = v[0], (len(v) - 1) // 2
                mean = v[1 : d + 1] / n
                out[name, f] = (int(n), mean, np.sqrt(np.maximum(0.0, v[d + 1 :] / n - mean * mean)))
    return out


def _newton_sums(classes: dict[str, list[str]], shared):
    def run(name: str, f: int, x: np.ndarray, y: np.ndarray) -> dict[int, np.ndarray]:
        return {g: model.sums(x, y) for (t, g), model in shared.value.items() if t == name and g != f}

    return lambda batches: _by_model(classes, batches, run)


def matrix_scaling(df: DataFrame, scores: list[str], label: str, group: str, folds: int = 5, reg: float = 0.1, seed: int = 0) -> DataFrame:
    """``df`` with ``fold`` and ``predicted``: out-of-fold multinomial logistic regression on the classes' scores, without
    standardising, folds by group. Scores aren't features of the content: this asks what a linear map of them could do."""
    rows = group_kfold(df, group, folds, seed).withColumn("_scores", F.array(*[F.col(c).cast("double") for c in scores]))
    labels = sorted(r[0] for r in rows.select(label).where(F.col(label).isNotNull()).distinct().collect())
    return out_of_fold(rows, "_scores", label, "fold", {"all": labels}, reg, False).drop("_scores", "task")


def linear_probe(df: DataFrame, features: str, label: str, group: str, folds: int = 5, reg: float = 0.1, seed: int = 0) -> DataFrame:
    """Out-of-fold predictions of a standardised L2 logistic regression on a feature array, folds by group: for all
    classes (``task`` is ``all``) and for each pair of them (``<a> vs <b>``, over rows of either)."""
    rows = group_kfold(df, group, folds, seed)
    labels = sorted(r[0] for r in rows.select(label).where(F.col(label).isNotNull()).distinct().collect())
    tasks = {"all": labels, **({f"{a} vs {b}": [a, b] for i, a in enumerate(labels) for b in labels[i + 1 :]} if len(labels) > 2 else {})}
    return out_of_fold(rows, features, label, "fold", tasks, reg, True)


def gate_check(metrics: DataFrame, metric: str, least: float, name: str = "gate") -> DataFrame:
    """``metrics`` with PASS where the metric is at least the threshold, else FAIL; an undefined metric fails."""
    return metrics.withColumn(name, F.when(F.coalesce(F.col(metric) >= least, F.lit(False)), "PASS").otherwise("FAIL"))


def separability_table(df: DataFrame, positive: Column, features: list[str]) -> DataFrame:
    """(feature, mean_pos, mean_neg, auc) of simple features, in one unpivoted pass."""
    from .metrics import auc_rank

    x = df.select(positive.alias("_y"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("x")).select("_y", "x.*")
    means = x.groupBy("feature").agg(F.avg(F.when(F.col("_y"), F.col("v"))).alias("mean_pos"), F.avg(F.when(~F.col("_y"), F.col("v"))).alias("mean_neg"))
    return means.join(auc_rank(x, F.col("_y"), "v", ["feature"]).select("feature", "auc"), "feature")
