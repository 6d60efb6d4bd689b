"""Fits of all folds at once against dense solutions, distances against all pairs, headers by their first bytes."""

from __future__ import annotations

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseflow.functions import labels as L
from caseflow.functions import text as X
from caseflow.operators import scores as C
from caseflow.operators import voxels as V
from caseflow.sources import readers, sinks


def data(seed=0, n=240, d=4):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    x = rng.normal(size=(n, d)) * [1, 5, 0.1, 1] + np.eye(3, d)[y] * [1.5, 6, 0.1, 0] + 7
    return x, y


def dense(x, y, k, reg):
    """Gradient descent's fixed point by many damped Newton steps over all rows at once."""
    mean, dev = x.mean(0), x.std(0)
    z, w = np.hstack([(x - mean) / dev, np.ones((len(x), 1))]), np.zeros((k, x.shape[1] + 1))
    pen = np.ones_like(w) * reg
    pen[:, -1] = 0
    for _ in range(60):
        p = np.exp(z @ w.T)
        p /= p.sum(1, keepdims=True)
        g = (p - np.eye(k)[y]).T @ z / len(x) + pen * w
        h = np.zeros((w.size, w.size))
        for i in range(k):
            for j in range(k):
                h[i * z.shape[1] : (i + 1) * z.shape[1], j * z.shape[1] : (j + 1) * z.shape[1]] = (z * (p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ z / len(x)
        w = w - 0.7 * np.linalg.lstsq(h + np.diag(pen.ravel()), g.ravel(), rcond=1e-12)[0].reshape(w.shape)
    return mean, dev, w


def test_joint_fits_equal_dense_solutions(spark, monkeypatch):
    x, y = data()
    fold = [k % 3 for k in range(len(y))]
    df = spark.createDataFrame([(k, x[k].tolist(), int(y[k]), fold[k]) for k in range(len(y))], "i int, x array<double>, y int, fold int").repartition(5)
    made, init = {}, C._Model.__init__

    def keep(self, *a):
        init(self, *a)
        made[len(made)] = self

    monkeypatch.setattr(C._Model, "__init__", keep)
    got = C.out_of_fold(df, "x", "y", "fold", {"all": [0, 1, 2], "0 vs 2": [0, 2]}, 0.05).collect()
    models = list(made.values())
    assert len(models) == 6 and len(got) == len(y) + int((y != 1).sum())
    predicted = {(r.task, r.i): r.predicted for r in got}
    found = 0
    for labels, name in (([0, 1, 2], "all"), ([0, 2], "0 vs 2")):
        for f in range(3):
            at = np.array([y[k] in labels and fold[k] != f for k in range(len(y))])
            mean, dev, w = dense(x[at], np.array([labels.index(v) for v in y[at]]), len(labels), 0.05)
            same = [m for m in models if m.weights.shape == w.shape and np.allclose(m.mean, mean) and np.allclose(m.dev, dev)]
            assert len(same) == 1 and np.abs(same[0].weights - w).max() < 1e-6
            found += 1
            for k in range(len(y)):
                if y[k] in labels and fold[k] == f:
                    assert predicted[name, k] == labels[int((np.append((x[k] - mean) / dev, 1) @ w.T).argmax())]
    assert found == 6
    right = np.mean([predicted["all", k] == y[k] for k in range(len(y))])
    assert right > 0.6  # labels are learned, out of their folds


def test_probes_of_odd_input(spark):
    rows = [(k, [float(k % 2), 1.0] if k % 5 else None, k % 2 if k % 7 else None) for k in range(60)]
    df = spark.createDataFrame(rows, "i int, x array<double>, y int")
    got = C.linear_probe(df, "x", "y", "i", 3).collect()  # a constant feature, missing features and labels
    assert {r.i for r in got} == {k for k in range(60) if k % 5 and k % 7} and all(r.predicted == r.y for r in got)
    assert C.linear_probe(df.limit(0), "x", "y", "i", 3).collect() == []
    one = C.linear_probe(df.where("y = 1"), "x", "y", "i", 3).collect()
    assert one and all(r.predicted == 1 for r in one)


@pytest.mark.parametrize("axes", [["x"], ["x", "y"], ["x", "y", "z"]])
def test_distances_equal_all_pairs(spark, axes):
    rng = random.Random(4)
    points = lambda n: [(rng.choice("pq"), *(rng.randrange(-9, 30) / 2 for _ in axes)) for _ in range(n)]
    a, b = points(150), [p for p in points(60) if p[0] == "p" or len(axes) > 1] + [("only b", *(1.0 for _ in axes))]
    schema = "g string, " + ", ".join(f"{c} double" for c in axes)
    got = V.nearest_distances(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["g"], axes).collect()
    want = sorted((g, round(min(math.dist(p, q) for h, *q in b if h == g), 9)) for g, *p in set(a) if any(h == g for h, *_ in b))
    assert sorted((r.g, round(r.d, 9)) for r in got) == want


def test_distances_run_nothing_before_they_are_asked_for(spark):
    df = spark.createDataFrame([("p", 1, 2)], "g string, x int, y int")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan", "")
    try:
        out = V.hd95(df, df, ["g"], ["x", "y"])
        assert not tracker.getJobIdsForGroup("plan")
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert out.first().hd95 == 0.0 and spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_headers_by_their_first_bytes(spark, tmp_path):
    for k in range(30):
        folder = tmp_path / f"s{k % 3}" / f"v{k // 3}"
        folder.mkdir(parents=True)
        for name in ("b.dat", "a.dat", "a.txt"):
            (folder / name).write_bytes(json.dumps({"k": k, "name": name}).encode().ljust(64) + b"\0" * 100_000)
    (tmp_path / "s0" / "v0" / "a.dat").write_bytes(b"no header")
    (tmp_path / "top.dat").write_bytes(b'{"k": 99}'.ljust(64))
    sizes = []

    def parse(raw: bytes) -> dict:
        return {**json.loads(raw.decode()), "size": len(raw)}

    for depth in (1, 2):
        got = {r.folder: r for r in readers.scan_headers(spark, str(tmp_path), parse, ["k", "name", "size"], "*.dat", 64, depth).collect()}
        assert len(got) == 31 and all(r.n_slices == 2 for f, r in got.items() if f != str(tmp_path))
        good = {f: r for f, r in got.items() if r.error is None}
        assert len(good) == 30 and {r.size for r in good.values()} == {"64"} and {int(r.k) for r in good.values()} == {*range(1, 30), 99}
        assert all(r.name == "a.dat" for f, r in good.items() if f != str(tmp_path))
        assert next(r for r in got.values() if r.error).error.startswith("JSONDecodeError")
        sizes.append(len(got))
    assert sizes == [31, 31]


def test_words_with_signs_and_clashing_names(spark):
    df = spark.createDataFrame([("T1 (post+c) a.b A*B C:\\E",)], "c string")
    assert df.select(X.remove_words("c", ["(post+c)", "a.b", "a*b", "\\E"])).first()[0] == "T1    C:"
    assert df.select(X.remove_words("c", [])).first()[0].startswith("T1")
    names = "tr te ti etl flip field description options scanning agent dose image_type b_value".split()
    row = dict.fromkeys(names, "") | {"tr": "500", "te": "12", "field": "1.5", "description": "SAG T1", "_tr": "mine", "_k": "too"}
    got = L.physics_label(spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} string" for c in row))).first()
    assert got["_tr"] == "mine" and got["_k"] == "too" and got["sequence"] == "T1W"


def test_combined_document(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 0)], "k string, v int")
    sinks.write_combined(df, str(tmp_path / "all"), "k")
    got = {r.k: [json.loads(x) for x in r.records] for r in spark.read.json(str(tmp_path / "all")).collect()}
    assert got == {"a": [{"v": 0}, {"v": 1}], "b": [{"v": 2}]}
    assert spark.read.json(str(tmp_path / "all")).where(F.size("records") > 1).count() == 1
