"""SimHash near-duplicates: fingerprints linked through vantage-point trees.

Two fingerprints within three bits agree to within one bit on one of their 32-bit halves. So each half gets a
vantage-point tree searched with radius one: a node sends a fingerprint to the inner child if its Hamming distance
to the vantage point is at most the node's median, and a search enters a child only where the triangle bound allows
a match. Whole 64-bit words would need radius three, which enters both children for over half of the fingerprints
at every level (54 % measured); halves do so for about one in four (27 %). Every fingerprint has one home shard per tree and visits the
shards that its search ball overlaps; a shard's points are split further by the same rule inside its task, and the
pairs that remain are compared exactly on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import join_counted, need, numbered, place, small_batches, stage, type_of
from .components import connected_components

SEED = 42
SHINGLE = 3
MAX_BITS = 3
#: Distinct fingerprints in a shard, on average, and the fingerprints from which the trees are built at most.
SHARD, TREE_SAMPLE = 2048, 65_536
#: Largest number of members or visitors in one unit of work; larger shards are cut into a grid of such units.
CELL = 100_000
#: Fingerprints that a task routes at a time.
ROUTED = 50_000
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_OFFSET = (np.arange(8, dtype=np.int64) * 256)[None, :]
_CHUNK = 1 << 16


def fingerprint(raw: bytes | None) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text: bits set in over half of its shingles' hashes; 0 without words.

    ``bytes.lower`` changes A-Z alone, and ``bytes.split`` splits at x20 and x09-x0D alone, as the contract asks.
    """
    words = (raw or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n < SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes) + np.arange(n)
    starts = (ends - sizes)[: n - SHINGLE + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)), np.uint64, n - SHINGLE + 1)
    ones = np.zeros((8, 8), np.int64)
    for at in range(0, len(hashes), _CHUNK):
        octets = hashes[at : at + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        ones += np.bincount((octets + _OFFSET).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(sum(1 << k for k in np.nonzero(ones.ravel() * 2 > len(hashes))[0].tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id, fp long holding the 64 bits). A null text counts as an empty one."""
    small_batches(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(1).cast(pa.binary()).to_pylist()
            fps = np.fromiter(map(fingerprint, raw), np.uint64, len(raw))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    rows = need(docs, id_col, text_col).toDF("id", "text").withColumn("text", F.col("text").cast("string"))
    return rows.mapInArrow(score, f"id {type_of(docs, id_col)}, fp long")


# ---------------------------------------------------------------- vantage-point trees


def _half(fps: np.ndarray, tree: int) -> np.ndarray:
    return (fps >> np.uint64(32 * tree)) & np.uint64(0xFFFFFFFF)


def build_tree(points: np.ndarray, depth: int, least: int = 4) -> list | None:
    """Nested ``[vantage, median, inner, outer]``; None is a leaf. The vantage point is the one of a few, evenly
    spread candidates whose split leaves fewest points within one of the border."""
    if depth == 0 or len(points) < least:
        return None
    best = None
    for vantage in points[:: max(1, len(points) // 8)]:
        d = np.bitwise_count(points ^ vantage)
        median = int(np.median(d))
        for cut in (median - 1, median):
            inside = int((d <= cut).sum())
            if 0 < inside < len(points):
                cost = (int((d <= cut + 1).sum()) ** 2 + int((d >= cut).sum()) ** 2)
                if best is None or cost < best[0]:
                    best = (cost, int(vantage), cut, d)
    if best is None or best[0] > 1.9 * len(points) ** 2:
        return None
    _, vantage, cut, d = best
    return [vantage, cut, build_tree(points[d <= cut], depth - 1, least), build_tree(points[d > cut], depth - 1, least)]


def route(tree: list | None, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """Yield (leaf number, indexes of the points whose ball of ``radius`` may hold points of that leaf)."""
    leaf = 0
    todo = [(tree, np.arange(len(points)))]
    while todo:
        node, at = todo.pop()
        if node is None:
            if len(at):
                yield leaf, at
            leaf += 1
            continue
        d = np.bitwise_count(points[at] ^ np.uint64(node[0])).astype(np.int64)
        todo.append((node[3], at[d + radius > node[1]]))
        todo.append((node[2], at[d - radius <= node[1]]))


class _Forest:
    """Union-find over the positions of an array."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        r = self.up[at]
        while True:
            nxt = self.up[r]
            if (nxt == r).all():
                self.up[at] = r
                return r
            r = nxt

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            keep = a != b
            a, b = a[keep], b[keep]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def _link(members: np.ndarray, visitors: np.ndarray, values: np.ndarray, forest: _Forest, tree: int, max_bits: int, leaf: int = 1024) -> None:
    """Join positions (in ``values``) of members and visitors within ``max_bits`` bits, splitting by vantage points."""
    todo = [(members, visitors)]
    while todo:
        m, v = todo.pop()
        if not len(m) or not len(v):
            continue
        if len(m) > leaf:
            half = _half(values[m], tree)
            node = build_tree(half[:: max(1, len(half) // 512)], 1)
            if node is not None:
                dm, dv = (np.bitwise_count(x ^ np.uint64(node[0])).astype(np.int64) for x in (half, _half(values[v], tree)))
                inner, outer = m[dm <= node[1]], m[dm > node[1]]
                if len(inner) and len(outer):
                    todo += [(inner, v[dv - 1 <= node[1]]), (outer, v[dv + 1 > node[1]])]
                    continue
        step = max(1, (1 << 21) // len(m))
        for at in range(0, len(v), step):
            part = v[at : at + step]
            near = np.bitwise_count(values[part][:, None] ^ values[m][None, :]) <= max_bits
            near &= part[:, None] > m[None, :]  # each pair meets twice; once is enough
            i, j = np.nonzero(near)
            if len(i):
                pairs = np.unique(np.stack([part[i], forest.roots(m[j])], 1), axis=0)
                forest.union(pairs[:, 0], pairs[:, 1])


def links(distinct: DataFrame, n: int, max_bits: int = MAX_BITS) -> DataFrame:
    """``distinct(fp)``, ``n`` rows -> edges (u, v) whose components are those of all pairs within ``max_bits`` bits.

    A unit of work gives a spanning forest of the pairs it found, so a group of any size gives at most one edge
    for each of its fingerprints and visits.
    """
    if max_bits > 3:
        raise ValueError("the halves' search radius of one covers three bits at most")
    spark = distinct.sparkSession
    depth = max(0, int(np.ceil(np.log2(max(1, n) / SHARD))))
    want = min(TREE_SAMPLE, 16 << depth)
    share = min(1.0, 1.5 * want / max(1, n))
    cut = int(share * 2**31)
    sample = [r.fp for r in distinct.where(F.pmod(F.xxhash64("fp"), F.lit(2**31)) < cut).orderBy(F.xxhash64("fp")).limit(want).collect()] if depth else []
    sample = np.array(sample, np.int64).view(np.uint64)
    trees = [build_tree(_half(sample, k), depth) for k in (0, 1)]
    shared = spark.sparkContext.broadcast(trees)

    def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        """Fingerprints in arrays large enough that each shard's share of one is worth a call."""
        held: list[np.ndarray] = []
        for pdf in batches:
            held.append(pdf["fp"].to_numpy(np.int64))
            if sum(map(len, held)) >= ROUTED:
                yield np.concatenate(held).view(np.uint64)
                held = []
        if held:
            yield np.concatenate(held).view(np.uint64)

    def visits(fps: np.ndarray) -> Iterator[tuple[int, np.ndarray, bool]]:
        for tree in (0, 1):
            half = _half(fps, tree)
            for home, radius in ((True, 0), (False, 1)):
                for leaf, at in route(shared.value[tree], half, radius):
                    yield 2 * leaf + tree, fps[at], home

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for fps in gathered(batches):
            rows = [(s, len(x), home) for s, x, home in visits(fps)]
            yield pd.DataFrame(rows, columns=["shard", "n", "home"])

    sizes = distinct.mapInPandas(count, "shard long, n long, home boolean").groupBy("shard").agg(F.sum(F.expr("if(home, n, 0)")).alias("m"), F.sum(F.expr("if(home, 0, n)")).alias("v"))
    grid = {r.shard: (-(-r.m // CELL), -(-r.v // CELL)) for r in sizes.where(f"m > {CELL} or v > {CELL}").collect()}

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for fps in gathered(batches):
            parts: list[tuple[int, np.ndarray, np.ndarray, bool]] = []
            for shard, own, home in visits(fps):
                rows, cols = grid.get(shard, (1, 1))
                mixed = (own * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
                at = (mixed % np.uint64(rows if home else cols)).astype(np.int64)
                parts += [(shard, at * cols + other if home else other * cols + at, own, home) for other in range(cols if home else rows)]
                if sum(len(p[2]) for p in parts) >= 4 * ROUTED:
                    yield dealt_rows(parts)
                    parts = []
            if parts:
                yield dealt_rows(parts)

    def dealt_rows(parts: list[tuple[int, np.ndarray, np.ndarray, bool]]) -> pd.DataFrame:
        sizes = [len(p[2]) for p in parts]
        return pd.DataFrame({"shard": np.repeat([p[0] for p in parts], sizes), "cell": np.concatenate([p[1] for p in parts]), "home": np.repeat([p[3] for p in parts], sizes), "fp": np.concatenate([p[2] for p in parts]).view(np.int64)})

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fps, home = pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["home"].to_numpy(bool)
        values, where = np.unique(fps, return_inverse=True)
        forest = _Forest(len(values))
        _link(np.unique(where[home]), np.unique(where[~home]), values, forest, int(key[0]) % 2, max_bits)
        roots = forest.roots(np.arange(len(values)))
        own = roots != np.arange(len(values))
        return pd.DataFrame({"u": values[own].view(np.int64), "v": values[roots[own]].view(np.int64)})

    dealt = distinct.mapInPandas(deal, "shard long, cell long, home boolean, fp long")
    return dealt.groupBy("shard", "cell").applyInPandas(compare, "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fingerprint hex, component_id) per row of ``docs``; component_id is the smallest id reachable.

    Ids are of any type that has an order, and keep it. Null and empty texts have fingerprint zero and link like any
    other; texts of any length are read whole. Repeated rows stay repeated, and link. A null id never names a component
    unless all of the component's ids are null. Extra columns are left behind, whatever their names. An empty table
    gives an empty result.
    """
    marked = stage(fingerprints(docs, id_col, text_col), "fp")
    # exact copies collapse before anything is compared
    distinct = stage(marked.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "fps")
    total = distinct.agg(F.count("*").alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    roots = connected_components(links(distinct.select("fp"), total["k"], max_bits))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    named = stage(named, "roots")
    # one component may hold most fingerprints, and one fingerprint most rows
    least = named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("k"))
    named = join_counted(named, least, "root", "k", total["k"]).select("fp", "component_id", "n")
    out = join_counted(marked, named, "fp", "n", total["n"])
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest id, one of them if it is repeated.

    Rows with a null id all stay. Columns keep their names and order, whatever the names are.
    """
    found = stage(simhash_components(docs, id_col, text_col, max_bits).toDF("id", "fp", "component"), "kept")
    n, ids = found.where("id is not null").agg(F.count("*"), F.countDistinct("id")).first()
    own, plain = f"_{place(docs, id_col)}", numbered(docs)
    keep = found.where("id = component").select(F.col("id").alias("keep")).distinct()
    kept = plain.join(keep, plain[own] == keep["keep"], "left_semi")
    if ids < n:  # repeated rows
        kept = kept.dropDuplicates([own])
    return kept.unionByName(plain.where(plain[own].isNull())).toDF(*docs.columns)
