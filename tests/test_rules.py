"""Branches of the label rules, answers and merges on hand-made rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from caseflow.functions import labels as L
from caseflow.functions import maps as M
from caseflow.functions import reply as P
from caseflow.operators import joins as J
from caseflow.operators import metrics as K
from caseflow.operators import rows as W
from caseflow.operators import scores as C
from caseflow.sources import readers, sinks

NAMES = ["description", "tr", "te", "ti", "field", "etl", "scanning", "b_value"]
SCANS = [
    (("SAG T1 FSE", "500", "12", "", "1.5", "3", "", ""), "T1W", ("T1W", "FSE", "", "")),
    (("AX STIR", "4000", "40", "150", "1.5", "", "", ""), "T2W", ("T2W", "IR", "STIR", "")),
    (("AX GRE T2", "600", "15", "", "3", "", "GR", ""), "T2*", ("T2*", "GRE", "", "")),
    (("COR PD", "2000", "8", "", "1.5", "", "", ""), "PD", ("PD", "SE", "", "")),
    (("AX T1 +C", "550", "10", "", "1.5", "", "", ""), "T1W", ("T1W", "SE", "", "Contrast")),
    (("DWI b800", "5000", "80", "", "3", "", "", "800"), "DWI", ("DWI", "SE", "", "")),
    (("SCOUT", "5", "2", "", "3", "", "", ""), "localizer", ("Localizer", "", "", "")),
    ((None, None, None, None, None, None, None, None), "", ("Unknown", "SE", "", "")),
]


def test_labels(spark):
    df = spark.createDataFrame([s[0] for s in SCANS], ", ".join(f"{n} string" for n in NAMES))
    df = df.withColumns({n: F.lit("") for n in ("flip", "options", "agent", "dose", "image_type")})
    got = L.physics_label(df.withColumn("k", L.keyword_label("description", "options"))).collect()
    assert [(r.k, (r.sequence, r.acquisition, r.fat_sat, r.contrast)) for r in got] == [(k, p) for _, k, p in SCANS]


@pytest.mark.parametrize(
    ("reply", "label"),
    [
        ('{"answer": "Round", "reason": "x"}', "round"),
        ('```json\n{"answer": "oval"}\n```', "oval"),
        ("<think>oval {\"answer\": \"oval\"}</think> it is round.", "round"),
        ("<think>never ends, round", "PARSE_FAILED"),
        ("round or oval", "PARSE_FAILED"),
        ("", "PARSE_FAILED"),
        (None, "PARSE_FAILED"),
    ],
)
def test_parse_answer(spark, reply, label):
    df = spark.createDataFrame([(reply, ["round", "oval"])], "reply string, options array<string>")
    assert P.parse_answers(df, "reply", "options").first().label == label


def test_literal_map(spark):
    df = spark.createDataFrame([("{'a': None, 'b': True, 'c': 'None here'}",)], "t string")
    assert df.select(M.parse_literal_map("t")).first()[0] == {"a": None, "b": "true", "c": "None here"}


def test_vote_ties_go_to_the_first(spark):
    df = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (2, 0, "PARSE_FAILED"), (2, 1, None)], "k int, pos int, l string")
    assert {r.k: r.vote for r in K.majority_vote(df, ["k"], "l", "pos").collect()} == {1: "b", 2: "PARSE_FAILED"}


def test_one_to_one_join_fails_on_duplicates(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(Exception, match="duplicate keys"):
        J.join_left_one_to_one(df, df.distinct(), ["k"]).collect()


def test_allocation_fits(spark):
    sizes = spark.createDataFrame([("a", 50), ("b", 3), ("c", 1)], "g string, size long")
    got = {r.g: r.alloc for r in W.stratified_alloc(sizes, "g", "size", 20, 2).collect()}
    assert sum(got.values()) == 20 and got["b"] >= 2 and got["c"] == 1


def test_auc_of_negated_score(spark):
    df = spark.range(200).select((F.col("id") % 3 == 0).alias("y"), (F.col("id") % 7).alias("s")).withColumn("n", -F.col("s"))
    a, b = (K.auc_rank(df, F.col("y"), c).first().auc for c in ("s", "n"))
    assert abs(a + b - 1) < 1e-12
    assert K.auc_rank(df.where("y"), F.col("y"), "s").first().auc is None


def test_append_twice_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(10).withColumnRenamed("id", "k")
    sinks.append_resumable(df, path, ["k"])
    sinks.append_resumable(df, path, ["k"])
    assert spark.read.parquet(path).count() == 10
    with pytest.raises(ValueError, match="columns differ"):
        sinks.append_guarded(df.withColumn("x", F.lit(1)), path)


def test_inventory_and_pairs(spark, tmp_path):
    for rel in ("s1/d1/3/images.nii.gz", "s1/d1/segs/3_seg.nii.gz", "s1/d1/segs/4_seg.nii.gz"):
        f = tmp_path / rel
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x")
    files = readers.scan_file_inventory(spark, str(tmp_path))
    deep = tmp_path / "s1" / "d1" / "3" / "more" / "x.dcm"  # under a session: no session of its own
    deep.parent.mkdir()
    deep.write_bytes(b"x")
    found = readers.session_inventory(readers.scan_file_inventory(spark, str(tmp_path)), str(tmp_path))
    assert {tuple(r) for r in found.collect()} == {("s1/d1", "s1/d1/3", "volume"), ("s1/d1", "s1/d1/segs", "none")}
    pairs = {r.scan: r.image for r in readers.pair_images_masks(files).collect()}
    assert pairs["4"] is None and pairs["3"].endswith("s1/d1/3/images.nii.gz")


def test_headers_keep_bad_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.dat").write_bytes(b"k=v")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "1.dat").write_bytes(b"broken")

    def parse(raw: bytes) -> dict:
        key, value = raw.decode().split("=")
        return {key: value}

    rows = readers.scan_scan_headers(spark, str(tmp_path), parse, ["k"]).collect()
    assert sorted((r.k, r.error is None, r.n_slices) for r in rows if r.k) == [("v", True, 1)]
    assert sum(r.error is not None for r in rows) == 1



def test_guards_raise(spark, tmp_path):
    ids = spark.createDataFrame([("1234567890123456",), ("1.2E15",)], "id string")
    with pytest.raises(Exception, match="rounded id"):
        readers.scan_text_keys(ids, "id").collect()
    for bad, what in (((" oval", ""), "without a path"), (("star", "a.png"), "not in")):
        with pytest.raises(Exception, match=what):
            J.exemplar_validate(spark.createDataFrame([bad], "label string, path string"), ["Oval"], base="/b").collect()
    good = J.exemplar_validate(spark.createDataFrame([(" OVAL ", "a.png"), ("oval", "/x.png")], "label string, path string"), ["Oval"], base="/b")
    assert {tuple(r) for r in good.collect()} == {("Oval", "/b/a.png"), ("Oval", "/x.png")}
    with pytest.raises(ValueError, match="no id column"):
        readers.included_ids(ids.withColumnRenamed("id", "key"), "key")
    sinks.append_guarded(ids, f"{tmp_path}/t")
    with pytest.raises(ValueError, match="changed"):
        sinks.append_guarded(ids.select(F.col("id").cast("binary").alias("id")), f"{tmp_path}/t")
    for k, labels in enumerate((["a", "b"], ["a", "c"])):
        spark.createDataFrame([(1, x, [1.0]) for x in labels], "k int, l string, v array<double>").write.parquet(f"{tmp_path}/e{k}")
    with pytest.raises(Exception, match="different labels"):
        readers.scan_embeddings(spark, [f"{tmp_path}/e0", f"{tmp_path}/e1"], "k", "l", "v").collect()


def test_replacement_recovers_from_a_crash(spark, tmp_path):
    path = f"{tmp_path}/t"
    sinks.write_table(spark.range(3), path)
    (tmp_path / "t").rename(tmp_path / "t.old")  # as a crash between the renames leaves it
    sinks.recover_in_place(spark, path)
    assert spark.read.parquet(path).count() == 3
    sinks.write_in_place(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2 and not (tmp_path / "t.old").exists()


def test_matched_scores_have_uniform_means(spark):
    rows = [(k, c, float((k * 7 + i * 3) % 11) / 3 + i) for k in range(40) for i, c in enumerate("abc")]
    matched, _ = C.marginal_matching(spark.createDataFrame(rows, "k int, c string, s double"), "k", "c", "s")
    means = C.softmax_rows(matched, "k", "matched").groupBy("c").agg(F.avg("p").alias("m")).collect()
    assert all(abs(r.m - 1 / 3) < 1e-4 for r in means)


def test_matrix_scaling_separates(spark):
    rows = [(k, k % 3, *[(5.0 if k % 3 == (j + 1) % 3 else 0.0) + (k * (j + 3)) % 7 / 10 for j in range(3)]) for k in range(120)]
    df = spark.createDataFrame(rows, "k long, y int, s0 double, s1 double, s2 double")
    got = C.matrix_scaling(df, ["s0", "s1", "s2"], "y", "k", 2).collect()
    assert len(got) == 120 and sum(r.predicted == r.y for r in got) >= 115
