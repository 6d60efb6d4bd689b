from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from caseflow.llm import simhash as S
from caseflow.llm.components import connected_components


def brute_fingerprint(text: str) -> int:
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for k in range(64):
            ones[k] += h >> k & 1
    return sum(1 << k for k in range(64) if ones[k] * 2 > len(shingles))


def brute_components(rows):
    ids, fps = [r[0] for r in rows], [S.fingerprint((r[1] or "").encode()) for r in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(ids[i])
    return {(ids[i], f"{fps[i]:016x}", min((x for x in groups[find(i)] if x is not None), default=None)) for i in range(len(rows))}


@pytest.mark.parametrize("text", ["", " \t\n", "One", "ONE two", "a b c d e", "É Ünï ÀB\x1cC x\x0by z", "w " * 200_000])
def test_fingerprint(text):
    assert S.fingerprint(text.encode()) == brute_fingerprint(text)


def test_null_is_empty():
    assert S.fingerprint(None) == 0


def corpus():
    rng = random.Random(5)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(40)) for _ in range(300)) for _ in range(30)]
    rows = [(k, t) for k, t in enumerate(base)]
    for k in range(60):  # near and exact copies
        words = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((1000 - k, " ".join(words)))
    return rows + [(5000, None), (5001, ""), (5002, "x"), (None, "x"), (1000, rows[-1][1]), (1000, rows[-1][1])]


def test_components_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "en", 7, "fp") for i, t in rows], "doc_id long, text string, lang string, n int, fp string")
    got = S.simhash_components(df).collect()
    assert len(got) == len(rows)
    assert {tuple(r) for r in got} == brute_components(rows)


def test_near_dedup_keeps_one(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i for i, _, c in brute_components(rows) if i is not None and i == c}
    kept = [r.doc_id for r in S.near_dedup(df).collect()]
    assert sorted(k for k in kept if k is not None) == sorted(want)
    assert kept.count(None) == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.simhash_components(df).count() == 0 and S.near_dedup(df).count() == 0


@pytest.mark.parametrize("cell", [100_000, 40])
def test_trees_lose_no_pair(monkeypatch, spark, cell):
    """Small shards, and with the small cell a grid of units, so that routing, the grid and local splits all take part."""
    monkeypatch.setattr(S, "SHARD", 64)
    monkeypatch.setattr(S, "CELL", cell)
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 2**63, 1500, dtype=np.uint64) * np.uint64(2)
    near = fps[:400].copy()
    for k in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)
    every = np.unique(np.concatenate([fps, near]))
    df = spark.createDataFrame([(int(x),) for x in every.view(np.int64)], "fp long")
    edges = S.links(df, len(every))
    roots = {r.node: r.root for r in connected_components(edges).collect()}
    close = np.bitwise_count(every[:, None] ^ every[None, :]) <= 3
    for i, j in zip(*np.nonzero(np.triu(close, 1)), strict=True):
        a, b = every.view(np.int64)[[i, j]].tolist()
        assert roots[a] == roots[b]
    assert len(roots) == int((close.sum(1) > 1).sum())


def test_chain_components(spark):
    df = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 100), (None, 3)], "u long, v long")
    got = {r.node: r.root for r in connected_components(df).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100}


def test_hub_of_many_edges(spark):
    """More edges than join_counted's limit, most of them at one hub."""
    edges = [(0, k) for k in range(1, 3000)] + [(5000 + k, 5001 + k) for k in range(40)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(3000), 0), **dict.fromkeys(range(5000, 5041), 5000)}


def test_ids_of_any_type_and_clashing_names(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [("b", text, "x", 1, 2), ("a", text, "y", 3, 4), ("c", "other words", "z", 5, 6), ("a", text, "y", 3, 4)]
    df = spark.createDataFrame(rows, "id string, body string, TEXT string, fp int, component int").toDF("doc_id", "text", "TEXT", "fp", "component")
    got = {(r.doc_id, r.component_id) for r in S.simhash_components(df).collect()}
    assert got == {("a", "a"), ("b", "a"), ("c", "c")}
    kept = S.near_dedup(df)
    assert kept.columns == df.columns and sorted(r[0] for r in kept.collect()) == ["a", "c"]
