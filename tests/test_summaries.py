"""Summaries, nearest dates of one subject, sketches, jitter and bands against plain Python and numpy."""

from __future__ import annotations

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseflow.operators import joins as J
from caseflow.operators import metrics as K
from caseflow.operators import summaries as Y
from caseflow.operators import voxels as V


def heads(spark):
    rows = [("a", "a", 0.9, {"a": 0.9, "b": 0.1}), ("a", "b", 0.6, {"a": 0.4, "b": 0.6}), ("b", "b", 0.8, {"a": 0.2}), (None, "a", 0.7, None), ("c", None, None, {"a": 0.5, "c": float(1)})]
    return spark.createDataFrame(rows, "t string, p string, q double, m map<string,double>")


def test_stages_by_hand(spark):
    df = heads(spark)
    all_, none = Y.Stage("all", F.col("t"), F.col("p"), F.col("q"), ["a", "b", "z"], None, F.col("m")), Y.Stage("none", F.col("t"), F.col("p"), F.col("q"), ["a"], F.lit(False))
    got = {r.stage: r for r in Y.evaluate_stages(df, [all_, none]).collect()}
    r = got["all"]
    assert (r.n, r.accuracy) == (5, pytest.approx(2 / 5))
    assert r.macro_precision == pytest.approx((1 / 2 + 1 / 2) / 2) and r.macro_recall == pytest.approx((1 / 2 + 1) / 2)  # z never occurs
    assert r.macro_f1 == pytest.approx((2 * 0.25 / 1 + 2 * 0.5 / 1.5) / 2)
    assert r.confidence_auc == pytest.approx(1.0)  # 0.9 and 0.8 over 0.6 and 0.7
    # a: 0.9, 0.4 against 0.2, 0.5; b: has no entry for its own row, so one class is left and it is undefined
    assert r.macro_ovr_auc == pytest.approx(3 / 4)
    assert tuple(got["none"]) == ("none", 0, None, None, None, None, None, None)
    assert {x.n for x in Y.evaluate_stages(df.limit(0), [all_, none]).collect()} == {0}


def test_class_report_and_agreement(spark):
    df = heads(spark)
    got = {r["class"]: r for r in Y.class_report(df, "t", "p", ["a", "b", "z"]).collect()}
    assert (got["a"].n, got["a"].predicted, got["a"].recall, got["a"].confusion, got["z"].recall, got["z"].confusion) == (2, 1, 0.5, "1,1,0", None, "0,0,0")
    assert (got["ALL"].n, got["ALL"].accuracy, got["ALL"].balanced, got["ALL"].chance) == (3, pytest.approx(2 / 3), 0.75, pytest.approx(1 / 3))
    assert Y.class_report(df.limit(0), "t", "p", ["a"]).where("class = 'ALL'").first().accuracy is None
    got = {(r.section, r.value): (r.share, r.n) for r in Y.agreement_report(df, "t", "p", ["q"], {"p": "t"}).collect()}
    assert got[("overall", "all")] == (pytest.approx(0.4), 5) and got[("accuracy", "p")] == (pytest.approx(2 / 3), 3) and got[("q", None)] == (0.0, 1)


def test_binary_tasks_by_hand(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["m", "i", "b", "x", None]), round(rng.random(), 1) if rng.random() < 0.9 else None) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, s double")
    tasks = {"mi-b": (["m", "i"], ["b"]), "m-rest": (["m"], ["i", "b"]), "nothing": (["q"], ["b"])}
    got = {(r.task, r.kind, r.cutoff): r for r in Y.binary_tasks(df, "g", ["s"], tasks, {"s": [0.5]}).collect()}
    for task, (pos, neg) in tasks.items():
        p, n = ([s for g, s in rows if g in side and s is not None] for side in (pos, neg))
        r = got[(task, "fixed", 0.5)]
        assert (r.tp, r.fp, r.fn, r.tn) == (sum(s >= 0.5 for s in p), sum(s >= 0.5 for s in n), sum(s < 0.5 for s in p), sum(s < 0.5 for s in n))
        if not p:
            assert r.auc is None and r.sensitivity is None
            continue
        assert r.auc == pytest.approx(sum((a > b) + (a == b) / 2 for a in p for b in n) / len(p) / len(n)) and (r.n_pos, r.n_neg) == (len(p), len(n))
        gain = {c: sum(s >= c for s in p) / len(p) - sum(s >= c for s in n) / len(n) for c in set(p + n)}
        best = max(gain, key=lambda c: (round(gain[c], 12), c))
        assert (task, "youden", best) in got


def test_rollups_shapes_and_progress(spark):
    rows = [("s", "done", "x"), ("s", "EXCLUDE ", ""), ("t", "done", " "), ("u", "exclude", None), ("v", "", "x"), ("", "done", "x"), (None, "done", "x")]
    df = spark.createDataFrame(rows, "k string, a string, b string")
    assert {tuple(r) for r in Y.category_rollup(df, "k", F.col("a"), F.col("b")).collect()} == {("s", 1, 0, 1, "both", True), ("t", 0, 1, 0, "only_segmented", False), ("u", 0, 0, 1, "excluded", False)}
    files = spark.createDataFrame([([1, 2, 3], None), ([1, 2, 3, 5], None), ([4], None), (None, None), ([1, 2, 3], "broken")], "s array<int>, e string")
    got = {(r.kind, r.value): r.n for r in Y.shape_report(files, "s", "e").collect()}
    assert got == {("note", "ok"): 1, ("note", "4D-multivolume"): 1, ("note", "UNEXPECTED-NDIM"): 1, ("note", "ERROR"): 2, ("ndim", "3"): 1, ("ndim", "4"): 1, ("ndim", "1"): 1, ("axis4", "5"): 1, ("error", "no shape"): 1, ("error", "broken"): 1}
    got = {tuple(r) for r in Y.review_progress(df, ["k"], F.col("b") == "x").collect()}
    assert ("k", "s", 2, 1, 1) in got and ("k", None, 1, 1, 0) in got and ("k", "u", 1, 0, 1) in got


def test_nearest_dates_of_one_subject_with_most_rows(spark):
    """A million rows of one subject: they meet by days, of which there are some thousands."""
    n = 1_000_000
    day = lambda c: F.date_add(F.lit("2000-01-01").cast("date"), c.cast("int"))
    rows = spark.range(n).select(F.lit("hot").alias("s"), F.col("id").alias("r"), day(F.pmod(F.xxhash64("id"), F.lit(4000)) * 2).alias("d"))
    sessions = spark.range(n).select(F.lit("hot").alias("s"), F.col("id").cast("string").alias("v"), day(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(9000)) - 500).alias("e"), F.lit(1).alias("c"))
    got = J.nearest_date_join(rows, sessions, "s", "r", "d", "v", "e", ["c"]).where("c is not null")
    first = {r.d: r.r for r in rows.groupBy("d").agg(F.min("r").alias("r")).collect()}
    have = sorted(first)
    import bisect

    want: dict[int, int] = {}
    for e, k in sessions.groupBy("e").count().collect():
        at = bisect.bisect_right(have, e)
        near = [have[x] for x in (at - 1, at) if 0 <= x < len(have)]
        best = min((abs((e - d).days), first[d]) for d in near)[1]
        want[best] = want.get(best, 0) + k
    assert {r.r: r.c for r in got.select("r", "c").collect()} == want and sum(want.values()) == n


def test_nearest_dates_edges(spark):
    d = lambda k: datetime.date(2024, 1, k)
    rows = spark.createDataFrame([("a", 1, d(5)), ("a", 2, d(9)), ("a", 3, None), ("b", 4, None), (None, 5, d(1))], "s string, r int, d date")
    sessions = spark.createDataFrame([("a", "x", d(7), 1), ("a", "y", None, 2), ("a", "z", d(30), 4), ("b", "w", d(1), 8), ("c", "q", d(1), 16)], "s string, v string, e date, c int")
    got = {r.r: (r.c, r.v) for r in J.nearest_date_join(rows, sessions, "s", "r", "d", "v", "e", ["c"]).collect()}
    assert got == {1: (3, "y"), 2: (4, "z"), 3: (None, None), 4: (8, "w"), 5: (None, None)}


def test_sketches_keep_their_error_and_merge_over_days(spark):
    df = spark.range(400_000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("day"), (F.col("id") % 90_001).cast("string").alias("who"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("g"))
    exact = {r.g: r.n for r in df.groupBy("g").agg(F.count_distinct("who").alias("n")).collect()}
    days = K.subject_sketches(df, ["g", "day"], "who")
    got = {r.g: (r.n, r.subjects) for r in K.estimated_subjects(K.merge_sketches(days, ["g"])).collect()}
    direct = {r.g: r.subjects for r in K.estimated_subjects(K.subject_sketches(df, ["g"], "who")).collect()}
    for g, n in exact.items():
        assert abs(got[g][1] - n) < 5 * 0.0065 * n and abs(direct[g] - got[g][1]) < 0.02 * n
    assert sum(n for n, _ in got.values()) == 400_000
    known = df.where("cast(who as int) < 45000").select("who").distinct()
    want = {r.g: r for r in K.overlap_summary(df, known, "g", "who").collect()}
    for r in K.estimated_overlap(df, known, "g", "who").collect():
        assert abs(r.total - want[r.g].total) < 0.03 * want[r.g].total and abs(r.known - want[r.g].known) < 0.05 * want[r.g].total and r.known + r.new == r.total
    none = K.estimated_subjects(K.subject_sketches(df.where("k < 0"), ["g"], "who")).collect()
    assert none == []


def test_jittered_boxes_stay_in_the_image(spark):
    rng = random.Random(1)
    rows = [(k, *(v for _ in "xy" for v in sorted(rng.choices(range(-5, 45), k=2)))) for k in range(3000)]
    df = spark.createDataFrame(rows, "k int, x0 int, x1 int, y0 int, y1 int")
    got = V.jitter_box(df, "k", F.lit(40), F.lit(30), 0.5, (0.2, 2.0), 9).collect()
    assert all(0 <= r.x0 < r.x1 <= 39 and 0 <= r.y0 < r.y1 <= 29 for r in got)
    again = V.jitter_box(df.repartition(7), "k", F.lit(40), F.lit(30), 0.5, (0.2, 2.0), 9).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in again}
    still = V.jitter_box(df.where("x0 >= 0 and x1 < 40 and x0 < x1 and y0 >= 0 and y1 < 30 and y0 < y1"), "k", F.lit(40), F.lit(30), 0.0, (1.0, 1.0)).collect()
    assert len(still) > 500 and all(abs(r.x0 - rows[r.k][1]) <= 1 and abs(r.y1 - rows[r.k][4]) <= 1 for r in still)
    draws = [r[0] for r in df.select(V.uniform("k", 1, 2)).collect()]
    assert abs(np.mean(draws) - 0.5) < 0.03 and 0 <= min(draws) and max(draws) < 1


def test_bands_equal_the_fft(spark):
    rng = np.random.default_rng(0)
    curve = rng.normal(size=36)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(curve)], "g string, i int, v double")
    amp = 2 * np.abs(np.fft.rfft(curve - curve.mean())) / 36
    row = V.harmonic_bands(df, ["g"], "i", "v", 36).first()
    assert row.lobe_amp == pytest.approx(math.sqrt((amp[3:8] ** 2).sum())) and row.jag_amp == pytest.approx(math.sqrt((amp[8:19] ** 2).sum()))
    assert V.harmonic_bands(df, ["g"], "i", "v", 36, {"low": (1, 2), "none": (20, 22)}).first().none is None
