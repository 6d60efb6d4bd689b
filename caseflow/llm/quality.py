"""Quality classifier: hashed word n-gram logistic regression, fitted by follow-the-regularised-leader (FTRL) updates.

A document becomes the set of its hashed words and word pairs; each shard of the bounded training sample makes FTRL
passes from the shared state, and the shards' states are averaged after each pass. Scoring is one sparse dot product
per document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import need, small_batches, stage, type_of
from .training import TRAIN_ROWS, held_out, labelled_sample

#: Size of the hashed feature space, FTRL settings, passes over the sample and shards that train side by side.
DIMENSIONS = 1 << 18
ALPHA, BETA, L1, L2 = 0.6, 1.0, 0.02, 0.2
PASSES, SHARDS = 4, 8
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_WORDS_KEPT = 500_000


class _Hashes(dict):
    """Hash of a word, kept for the words met lately."""

    def __missing__(self, word: str) -> int:
        if len(self) > _WORDS_KEPT:
            self.clear()
        h = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return h


_HASHES = _Hashes()


def features(text: str | None, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Sorted distinct positions of a text's words, runs of signs, pairs of neighbours and two marks of repetition;
    position 0 is the bias."""
    tokens = _TOKEN.findall(text or "")
    words = np.fromiter(map(_HASHES.__getitem__, tokens), np.uint64, len(tokens))
    pairs = words[:-1] * np.uint64(0x9E3779B1) + words[1:] * np.uint64(0x85EBCA6B) + np.uint64(1)
    # how often words repeat is lost in a set: the share of distinct words and that of doubled words, in steps, are
    # tokens of their own
    spread = int(np.log2(max(1, len(tokens)) / max(1, len(set(tokens)))) * 2) if tokens else -1
    doubled = int(np.searchsorted([0.02, 0.1, 0.3, 0.6], float((words[1:] == words[:-1]).mean()))) if len(words) > 1 else -1
    shape = np.array([zlib.crc32(b"\0spread%d" % spread), zlib.crc32(b"\0doubled%d" % doubled)], np.uint64)
    both = np.concatenate([words, pairs >> np.uint64(3), shape]) % np.uint64(dimensions - 1)
    seen = np.zeros(dimensions, bool) if len(both) > dimensions // 8 else None
    if seen is None:
        return np.concatenate([[0], np.unique(both).astype(np.int64) + 1])
    seen[0] = True
    seen[both.astype(np.int64) + 1] = True
    return np.nonzero(seen)[0]


def _value(n: int) -> float:
    return 1.0 / np.sqrt(max(1, n - 1))


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _margin(w: np.ndarray, at: np.ndarray) -> float:
    return float(w[0] + w[at[1:]].sum() * _value(len(at)) * 4)


def _sigmoid(x: float) -> float:
    return float(1.0 / (1.0 + np.exp(-max(-35.0, min(35.0, x)))))


def ftrl_pass(rows: list[np.ndarray], labels: list[int], z: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pass of per-coordinate FTRL-proximal updates over (features, label) rows, from state (z, n)."""
    z, n = z.copy(), n.copy()
    for at, y in zip(rows, labels, strict=True):
        w = _weights(z[at], n[at])
        x = np.full(len(at), 4 * _value(len(at)))
        x[0] = 1.0
        g = (_sigmoid(float(w @ x)) - y) * x
        sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
        z[at] += g - sigma * w
        n[at] += g * g
    return z, n


def _shard_passes(state):
    """Function that makes one pass over each shard of a partition, row by row, and gives the changes of its state."""

    def update(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, z0, n0 = None, *state.value
        z, n = z0, n0

        def changes() -> pd.DataFrame:
            at = np.nonzero((z != z0) | (n != n0))[0]
            return pd.DataFrame({"at": at, "dz": z[at] - z0[at], "dn": n[at] - n0[at]})

        for pdf in batches:  # sorted by shard and id
            for k, rows in pdf.groupby("shard", sort=False):
                if k != shard:
                    if shard is not None:
                        yield changes()
                    shard, z, n = k, z0, n0
                z, n = ftrl_pass([np.asarray(a, np.int64) for a in rows["at"]], rows["label"].tolist(), z, n)
        if shard is not None:
            yield changes()

    return update


def train(sample: DataFrame, passes: int = PASSES, shards: int = SHARDS, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Weights from a bounded ``sample(id, text, label)``. What reaches the driver is ``dimensions`` states a pass."""
    spark = sample.sparkSession
    small_batches(spark)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "label": pdf["label"], "at": [features(t, dimensions).tolist() for t in pdf["text"]]})

    rows = stage(sample.mapInPandas(extract, f"id {type_of(sample, 'id')}, label int, at array<int>"), "ftrl").withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    used = max(1, rows.select("shard").distinct().count())
    z, n = np.zeros(dimensions), np.zeros(dimensions)
    rows = rows.repartition(shards, "shard").sortWithinPartitions("shard", "id")
    for _ in range(passes):
        state = spark.sparkContext.broadcast((z, n))

        moved = rows.mapInPandas(_shard_passes(state), "at long, dz double, dn double").groupBy("at").agg(F.sum("dz").alias("dz"), F.sum("dn").alias("dn")).toPandas().sort_values("at")
        at = moved["at"].to_numpy(np.int64)
        z[at] += moved["dz"].to_numpy() / used
        n[at] += moved["dn"].to_numpy() / used
    return _weights(z, n)


def score_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, rows: int = TRAIN_ROWS) -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``, from its whole text.

    A null text scores as an empty one, by the bias and the two marks of repetition; a text of any length is scored
    whole; repeated rows stay repeated; extra columns are left behind; an empty table gives an empty result; without
    labels every score is 0.5.
    """
    spark = docs.sparkSession
    small_batches(spark)
    weights = spark.sparkContext.broadcast(train(labelled_sample(docs, labels, label_col, id_col, text_col, rows)))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        w = weights.value
        return pd.Series([_sigmoid(_margin(w, features(t))) for t in texts], dtype="float64")

    out = need(docs, id_col, text_col).select(F.col(f"`{id_col}`"), held_out(F.col(f"`{id_col}`")).alias("held_out"), score(F.col(f"`{text_col}`").cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
