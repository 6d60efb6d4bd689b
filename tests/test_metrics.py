"""Ranks, percentiles and bootstrap on skewed input: the same values, and no task that holds a group."""

from __future__ import annotations

import hashlib
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseflow.operators import metrics as M
from caseflow.operators import rows as W
from caseflow.operators import voxels as V


def auc(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None


def scored(seed, n=400):
    rng = random.Random(seed)
    # one group holds most rows, all of its scores within what would be one range of the others
    return [("big" if rng.random() < 0.8 else rng.choice(["a", None]), (rng.random() / 1e6 if rng.random() < 0.8 else 5.0) if rng.random() < 0.9 else rng.uniform(-9, 9), rng.random() < 0.4) for _ in range(n)]


@pytest.mark.parametrize("cut", [0, 10_000])
def test_auc_and_percentiles_by_group(spark, monkeypatch, cut):
    monkeypatch.setattr(M, "CUT_FROM", cut)
    rows = scored(1)
    df = spark.createDataFrame(rows, "g string, s double, y boolean")
    got = {r.g: r.auc for r in M.auc_rank(df, F.col("y"), "s", ["g"]).collect()}
    want = {g: auc([(s, y) for h, s, y in rows if h == g]) for g in {r[0] for r in rows}}
    assert got == pytest.approx(want)
    five = {r.g: (r.low, r.q1, r.median, r.q3, r.high) for r in M.five_number_summary(df, ["g"], "s").collect()}
    assert five == {g: pytest.approx(tuple(np.percentile([s for h, s, _ in rows if h == g], [0, 25, 50, 75, 100]))) for g in want}
    curve = {(r.g, r.threshold): (r.tpr, r.fpr) for r in M.roc_curve(df, F.col("y"), "s", ["g"]).collect()}
    for (g, t), (tpr, fpr) in list(curve.items())[:50]:
        own = [(s, y) for h, s, y in rows if h == g]
        assert tpr == pytest.approx(sum(s >= t and y for s, y in own) / sum(y for _, y in own)) and fpr == pytest.approx(sum(s >= t and not y for s, y in own) / sum(not y for _, y in own))


def test_a_group_within_one_range_of_the_others_is_split(spark, monkeypatch):
    monkeypatch.setattr(M, "CUT_FROM", 100)
    h = spark.range(20_000).select(F.when(F.col("id") < 15_000, "big").otherwise("wide").alias("g"), F.when(F.col("id") < 15_000, F.col("id") / 1e9).otherwise(F.col("id") * 1.0).alias("s"), F.lit(1).alias("n"))
    sizes = M._ranged(h, "s", ["n"], ["g"]).groupBy("g", "_range").count().where("g = 'big'").select("count").collect()
    assert len(sizes) >= 60 and max(r[0] for r in sizes) < 15_000 / 30


def test_the_input_is_scanned_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "CUT_FROM", 0)
    path = str(tmp_path / "t")
    spark.createDataFrame(scored(2), "g string, s double, y boolean").write.parquet(path)
    for df in (M.auc_rank(spark.read.parquet(path), F.col("y"), "s"), M.roc_curve(spark.read.parquet(path), F.col("y"), "s")):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert 1 <= plan.count("FileScan") <= 1 + plan.count("ReusedExchange")


@pytest.mark.parametrize("hot", [0.0, 0.9])
def test_bootstrap_equals_weighted_pairs(spark, hot):
    """Also where one score holds nearly all rows, whose ties then lie in many tasks, and with scores that are no numbers."""
    rng = random.Random(3)
    rows = [(k if k % 17 else None, 0.5 if rng.random() < hot else rng.choice([rng.random(), 0.25, float("nan")]), rng.random() < 0.5 if k % 13 else None) for k in range(300)]
    df = spark.createDataFrame(rows, "k int, s double, y boolean").repartition(5)
    steps, found = M.poisson_steps(), []
    for r in range(9):
        weighted = []
        for k, s, y in rows:
            u = int(hashlib.md5((f"7:{r}" + ("" if k is None else f":{k}")).encode()).hexdigest()[:8], 16)
            weighted += [(1e9 if s != s else s, bool(y))] * next((n for limit, n in steps if u < limit), len(steps))
        found.append(auc(weighted))
    row = M.bootstrap_auc_ci(df, F.col("y"), "s", "k", 9, 7).first()
    assert (row.low, row.high, row.replicates) == (pytest.approx(np.percentile(found, 2.5)), pytest.approx(np.percentile(found, 97.5)), 9)


def test_bootstrap_of_one_class_and_of_nothing(spark):
    df = spark.createDataFrame([(1, 0.5, True)], "k int, s double, y boolean")
    for x in (df, df.limit(0)):
        assert tuple(M.bootstrap_auc_ci(x, F.col("y"), "s", "k", 3).first()) == (None, None, 0)


def test_constant_and_empty_input_never_fails(spark):
    df = spark.createDataFrame([("a", 2.0, 1)] * 5, "g string, v double, n int")
    none = df.limit(0)
    assert [tuple(r) for r in M.histogram_bins(df, "v").collect()] == [(0, 5)] and M.histogram_bins(none, "v").collect() == []
    for x in (df, none, df.withColumn("v", F.lit(None).cast("double"))):
        for out in (M.value_counts_pct(x, "v"), M.group_stats(x, ["g"], "v"), M.metric_by_group(x, ["g"], "v", "n"), M.distribution_profile(x, ["v", "n"]), M.five_number_summary(x, ["g"], "v"), M.auc_rank(x, F.col("n") > 0, "v"),
                    M.roc_curve(x, F.col("n") > 0, "v"), M.cutoff_metrics(x, F.col("n") > 0, "v", [1]), M.top_value_share(x, ["g"], "v"), M.macro_metrics(M.per_class_metrics(x, "g", "g"))):
            out.collect()
    assert [r.alloc for r in W.stratified_alloc(spark.createDataFrame([("a", 0), ("b", 0)], "g string, n int"), "g", "n", 4).collect()] == [0, 0]
    assert spark.range(1).select(V.margin_to_px(3.0, F.lit(0.0))).first()[0] is None


def test_balanced_assign_of_one_group(spark):
    """One group of all rows: counts differ by one at most, the order is that of the hash, and buckets are small."""
    df = spark.range(5000).select(F.col("id").alias("k"), F.lit("g").alias("g"))
    got = W.balanced_assign(df, "k", ["x", "y", "z"], "g", 4).collect()
    by = {c: sum(r["class"] == c for r in got) for c in "xyz"}
    assert max(by.values()) - min(by.values()) <= 1
    order = sorted(range(5000), key=lambda k: hashlib.md5(f"4:{k}".encode()).hexdigest())
    assert {r.k: r["class"] for r in got} == {k: "xyz"[i % 3] for i, k in enumerate(order)}
    sizes = df.withColumn("o", W.hash_rank("k", 4)).groupBy(F.substring("o", 1, 2)).count().collect()
    assert len(sizes) > 200 and max(r[1] for r in sizes) < 100


def test_picks_by_a_column_of_numbers(spark):
    rows = [(g, k, random.Random(k).randrange(50)) for g, n in (("hot", 900), ("a", 3), (None, 5)) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, k int, o int").withColumn("most", F.when(F.col("g") == "hot", 7).otherwise(2))
    got = {(r.g, r.k) for r in W.top_per_group(df, ["g"], ["o", "k"], F.col("most")).collect()}
    want = {(g, k) for g, n in (("hot", 7), ("a", 2), (None, 2)) for _, k in sorted((o, k) for h, k, o in rows if h == g)[:n]}
    assert got == want
    more = {(r.g, r.more) for r in W.preview_with_rest(df, ["g"], ["o", "k"], 4).collect()}
    assert more == {("hot", 896), ("a", -1), (None, 1)}


def test_medians_equal_those_of_whole_groups(spark):
    rows = [(f"g{k % 3}" if k % 3 else None, float(random.Random(k).randrange(9)), k) for k in range(101)]
    df = spark.createDataFrame(rows, "g string, v double, k int")
    got = {r.g: (r.median, r.score_median, r.category) for r in M.group_stats(df, ["g"], "v", "k", "k", "k").collect()}
    assert got == {g: (statistics.median(v for h, v, _ in rows if h == g), statistics.median(k for h, _, k in rows if h == g), min(k for h, _, k in rows if h == g)) for g in {r[0] for r in rows}}
