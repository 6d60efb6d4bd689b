"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample; every vector is assigned to a leaf. A query walks the tree through a priority
queue of node distances, so it meets leaves from the nearest outwards. How many leaves it visits is calibrated: exact
neighbours of a few probe queries are found over all vectors in blocks, and visits widen until the probes' recall
reaches the target (all leaves in the limit). Visits and vectors then meet by leaf, in units of bounded size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import need, stage

#: Neighbours, queries (ids divisible by this), children of a node.
NEIGHBOURS, QUERY_STEP, BRANCHING = 5, 50, 8
#: Vectors in a leaf on average, vectors in the sample for each leaf, and numbers in the sample at most: leaves grow with
#: the vectors until the sample is full.
LEAF_ROWS, SAMPLED, FIT_VALUES = 256, 4, 1 << 23
#: Probe queries, and the recall at which widening stops.
PROBES, RECALL = 128, 0.97
#: Vectors and visits in one unit of work at most.
BLOCK_VECTORS, BLOCK_VISITS = 20_000, 4_096


def usable(vector: str) -> str:
    """SQL condition: not null, without null or non-finite components, not zero."""
    return f"coalesce(size({vector}) > 0 and not exists({vector}, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists({vector}, x -> x <> 0), false)"


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 1))


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _scaled(m: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which loses no bit, so that their squares neither overflow nor vanish."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1])


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row pair, summed the same way for every row, so that equal vectors tie exactly."""
    a, b = _scaled(a), _scaled(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


class KMeansTree:
    """Nested k-means centres of unit vectors; leaves are numbered in order."""

    def __init__(self, sample: np.ndarray, leaves: int, branching: int = BRANCHING, rounds: int = 6) -> None:
        self.centres: list[np.ndarray] = []
        self.children: list[np.ndarray] = []
        self.leaf: list[int] = []
        self.leaves = 0
        self._grow(sample, leaves, branching, rounds)

    def _grow(self, points: np.ndarray, leaves: int, branching: int, rounds: int) -> int:
        node = len(self.leaf)
        self.leaf.append(-1)
        self.centres.append(np.zeros((0, points.shape[1])))
        self.children.append(np.zeros(0, np.int64))
        k = min(branching, leaves, len(np.unique(points, axis=0)) if len(points) < 1000 else branching)
        if k < 2:
            self.leaf[node] = self.leaves
            self.leaves += 1
            return node
        centres = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
        for _ in range(rounds):
            own = self._nearest(points, centres)
            for j in range(k):
                if (own == j).any():
                    centres[j] = points[own == j].mean(0)
        own = self._nearest(points, centres)
        used = [j for j in range(k) if (own == j).any()]
        if len(used) < 2:
            self.leaf[node] = self.leaves
            self.leaves += 1
            return node
        share = [max(1, round(leaves * (own == j).mean())) for j in used]
        self.centres[node] = centres[used]
        self.children[node] = np.array([self._grow(points[own == j], n, branching, rounds) for j, n in zip(used, share, strict=True)])
        return node

    @staticmethod
    def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.argmin((centres * centres).sum(1)[None, :] - 2 * points @ centres.T, axis=1)

    def assign(self, units: np.ndarray) -> np.ndarray:
        """Leaf of each unit vector, by the nearest centre at every level."""
        out = np.zeros(len(units), np.int64)
        todo = [(0, np.arange(len(units)))]
        while todo:
            node, at = todo.pop()
            if self.leaf[node] >= 0:
                out[at] = self.leaf[node]
            elif len(at):
                own = self._nearest(units[at], self.centres[node])
                todo += [(int(child), at[own == j]) for j, child in enumerate(self.children[node])]
        return out

    def visit(self, unit: np.ndarray, most: int, held: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first ``most`` leaves best bin first, and more until they hold ``least``; ``held`` has the number in each leaf.

        The nearest open node is opened next.
        """
        queue, out, total = [(0.0, 0)], [], 0
        while queue and (len(out) < most or total < least):
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
                total += least and int(held[self.leaf[node]])
                continue
            gap = ((self.centres[node] - unit) ** 2).sum(1)
            for d, child in zip(gap.tolist(), self.children[node].tolist(), strict=True):
                heapq.heappush(queue, (d, child))
        return out


def fit(vectors: DataFrame, n: int, values: int = FIT_VALUES) -> KMeansTree | None:
    """Tree from a sample of ``vectors(id, v)``, ``n`` in all, chosen by a hash of the id: SAMPLED vectors for each leaf
    that has LEAF_ROWS, as far as they hold at most ``values`` numbers."""
    length = vectors.select(F.size("v")).first()
    if length is None:
        return None
    rows = max(1, min(max(20_000, SAMPLED * (n // LEAF_ROWS)), values // length[0]))
    share = min(1.0, 1.2 * rows / max(1, n))
    chosen = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 31)) < int(share * (1 << 31)))
    sample = chosen.orderBy(F.xxhash64("id"), "id").limit(rows).select("v").toPandas()["v"]
    if not len(sample):
        return None
    return KMeansTree(_unit(_matrix(sample)), max(1, min(n // LEAF_ROWS, len(sample) // SAMPLED)))


def calibrate(vectors: DataFrame, probes: DataFrame, tree: KMeansTree, k: int = NEIGHBOURS, recall: float = RECALL) -> int:
    """Leaves to visit so that a query finds ``recall`` of its exact ``k`` neighbours on average over the probes."""
    asked = probes.toPandas()
    if not len(asked):
        return 1
    shared = vectors.sparkSession.sparkContext.broadcast((asked["id"].to_numpy(), _unit(_matrix(asked["v"])), tree))

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, units, tree = shared.value
        for pdf in batches:
            own = _unit(_matrix(pdf["v"]))
            near = units @ own.T
            near[ids[:, None] == pdf["id"].to_numpy()[None, :]] = -9.0
            top = np.argsort(-near, axis=1)[:, :k]
            at = np.repeat(np.arange(len(ids)), top.shape[1])
            yield pd.DataFrame({"probe": at, "id": pdf["id"].to_numpy()[top.ravel()], "score": near[at, top.ravel()], "leaf": tree.assign(own)[top.ravel()]})

    order = Window.partitionBy("probe").orderBy(F.desc("score"), "id")
    best = vectors.mapInPandas(exact, "probe long, id long, score double, leaf long").where("score > -5").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    place = [{leaf: j for j, leaf in enumerate(tree.visit(u, tree.leaves))} for u in shared.value[1]]
    needed = sorted(place[r.probe][r.leaf] for r in best.collect())
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))] + 1 if needed else 1


def nearest(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEIGHBOURS, step: int = QUERY_STEP, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest rows found, by cosine; ties to the smaller id.

    Queries are the rows whose id, a whole number, is divisible by ``step``. Rows with a null id, and vectors that are
    null, zero, or hold null or non-finite components, take no part. Vectors of each length are searched by themselves:
    there is no cosine between lengths. Rows of one id act as one row, by their nearest vectors. Fewer candidates than
    ``k`` give fewer rows, an empty table none. Extra columns are left behind.
    """
    spark = table.sparkSession
    rows = need(table, id_col, vector_col).toDF("id", "v").withColumns({"id": F.col("id").cast("long"), "v": F.col("v").cast("array<double>")})
    rows = rows.where("id is not null").where(usable("v"))
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count_if(F.col("id") % step == 0).alias("asked")).where("asked > 0").select("d")
    for length in sorted(r["d"] for r in lengths.collect()):
        out = out.unionByName(_nearest(rows.where(F.size("v") == length), k, step, recall))
    if rows.select("id").distinct().count() == rows.count():
        return out
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # an id may have vectors of several lengths
    out = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _nearest(rows: DataFrame, k: int, step: int, recall: float) -> DataFrame:
    """:func:`nearest` among ``rows(id, v)`` of one length."""
    spark = rows.sparkSession
    rows = stage(rows, "vectors")
    # of equal vectors only the k + 1 smallest ids can be anyone's neighbours; the limit is applied before the shuffle
    copies = Window.partitionBy("v").orderBy("id")
    points = stage(rows.withColumn("copy", F.dense_rank().over(copies)).where(F.col("copy") <= k + 1).select("id", "v").distinct(), "points")
    queries = rows.where(F.col("id") % step == 0)
    n = points.count()
    tree = fit(points, n)
    probes = queries.orderBy(F.xxhash64("id", F.lit("probe")), "id").limit(PROBES)
    most = calibrate(points, probes, tree, k, recall)
    shared = spark.sparkContext.broadcast(tree)

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(leaf=shared.value.assign(_unit(_matrix(pdf["v"]))))

    homes = stage(points.mapInPandas(leaves, "id long, v array<double>, leaf long"), "leaves")
    held = np.zeros(tree.leaves, np.int64)  # an id with several vectors counts in one of its leaves
    for leaf, count in homes.groupBy("id").agg(F.min("leaf").alias("leaf")).groupBy("leaf").agg(F.count("*")).collect():
        held[leaf] = count

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(leaf=[shared.value.visit(u, most, held, k + 1) for u in _unit(_matrix(pdf["v"]))])

    walks = stage(queries.mapInPandas(visits, "id long, v array<double>, leaf array<long>"), "walks")
    asked = walks.select("id", "v", F.explode("leaf").alias("leaf"))
    # a leaf's vectors and visits form a grid of units; both counts are bounded by the number of leaves
    n_vectors = dict(homes.groupBy("leaf").agg(F.count("*")).collect())
    n_visits = dict(asked.groupBy("leaf").agg(F.count("*")).collect())
    cuts = spark.createDataFrame([(leaf, -(-n_vectors[leaf] // BLOCK_VECTORS), -(-n_visits[leaf] // BLOCK_VISITS)) for leaf in n_vectors if leaf in n_visits] or [(-1, 1, 1)], "leaf long, n_v long, n_q long")
    cuts = F.broadcast(cuts)  # a row for each leaf
    left = homes.join(cuts, "leaf").select("leaf", F.pmod(F.xxhash64("id"), "n_v").alias("block"), F.explode(F.expr("sequence(0L, n_q - 1)")).alias("chunk"), F.lit(False).alias("asks"), "id", "v")
    right = asked.join(cuts, "leaf").select("leaf", F.explode(F.expr("sequence(0L, n_v - 1)")).alias("block"), F.pmod(F.xxhash64("id"), "n_q").alias("chunk"), F.lit(True).alias("asks"), "id", "v")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        q, c = pdf[pdf["asks"]], pdf[~pdf["asks"]].sort_values("id")
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        qm, cm, q_id, c_id = _matrix(q["v"]), _matrix(c["v"]), q["id"].to_numpy(), c["id"].to_numpy()
        cu, out = _unit(cm), []
        for at in range(0, len(qm), 256):
            near = _unit(qm[at : at + 256]) @ cu.T
            near[q_id[at : at + 256, None] == c_id[None, :]] = -9.0
            short = min(k, near.shape[1])
            least = np.partition(near, near.shape[1] - short, axis=1)[:, near.shape[1] - short]
            i, j = np.nonzero((near >= least[:, None] - 1e-9) & (near > -5.0))
            out.append(pd.DataFrame({"query_id": q_id[at + i], "vec_id": c_id[j], "score": cosine(qm[at + i], cm[j])}))
        found = pd.concat(out).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return found.groupby("query_id").head(k)

    pairs = left.unionByName(right).groupBy("leaf", "block", "chunk").applyInPandas(search, "query_id long, vec_id long, score double")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
