"""Many small files: written by tasks, listed by a task for each core."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import pytest
from caseflow.plans import files as plans
from caseflow.plans.registry import Tables
from caseflow.sources import readers, sinks

SF_DIR = "/root/testdata/sf0.001"


@contextmanager
def tasks_of(spark):
    """Filled on exit with the number of tasks of each stage that ran within."""
    group, counts = uuid.uuid4().hex, []
    spark.sparkContext.setJobGroup(group, group)
    yield counts
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    counts += [info.numTasks for info in map(tracker.getStageInfo, stages) if info and info.numCompletedTasks]


@pytest.fixture
def many(tmp_path):
    """50 folders of a file each, more than Spark lists in the driver."""
    for k in range(50):
        (tmp_path / f"many/{k}").mkdir(parents=True)
        (tmp_path / f"many/{k}/a.json").write_text(f'{{"block": {{"f": "{k}"}}}}')
    return str(tmp_path / "many")


def test_inventory_is_listed_by_a_task_for_each_core(spark, many):
    before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    with tasks_of(spark) as counts:
        found = readers.scan_file_inventory(spark, many)
    assert counts == [spark.sparkContext.defaultParallelism]
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before
    assert {(r.scan, r.file) for r in found.collect()} == {(str(k), "a.json") for k in range(50)}


def test_tree_is_written_by_several_tasks(spark):
    with tasks_of(spark) as counts:
        plans.tree(Tables(spark, SF_DIR))
    assert max(counts) > 1


def test_files_hold_their_rows(spark, tmp_path):
    rows = [(f"a={k % 3}/b={k}/part-0", f"é{k}\n") for k in range(20)] + [("none", None), ("x.gz", "as it is")]
    for root in (str(tmp_path / "x"), f"file://{tmp_path}/y"):
        sinks.write_files(spark.createDataFrame(rows, "path string, value string"), root)
    for k in ("x", "y"):
        assert {str(p.relative_to(tmp_path / k)): p.read_text() for p in (tmp_path / k).rglob("*") if p.is_file()} == {p: v or "" for p, v in rows}
    with pytest.raises(Exception, match="path given twice: none"):
        sinks.write_files(spark.createDataFrame([*rows, ("none", "x")], "path string, value string"), str(tmp_path / "z"))


def test_store_that_only_spark_opens(spark, tmp_path, monkeypatch):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.tests.link./in", f"file://{tmp_path}")
    monkeypatch.setattr(plans, "_folder", lambda t: "viewfs://tests/in/tree")
    found = plans.QUERIES["scan_file_inventory"](spark, SF_DIR)
    monkeypatch.undo()
    assert sorted(found.collect()) == sorted(plans.QUERIES["scan_file_inventory"](spark, SF_DIR).collect())


def test_documents_are_listed_by_a_task_for_each_core(spark, many):
    with tasks_of(spark) as counts:
        found = readers.scan_json_docs(spark, many, "block", r"(\d+)/a")
    assert counts == [spark.sparkContext.defaultParallelism]
    assert {(r.id, r.feature, *r["values"]) for r in found.collect()} == {(str(k), "f", str(k)) for k in range(50)}


def test_documents_are_written_by_several_tasks(spark):
    with tasks_of(spark) as counts:
        plans.QUERIES["scan_json_docs"](spark, SF_DIR)
    assert max(counts) > 1


def test_sessions_are_written_and_listed_by_tasks(spark, many, monkeypatch):
    with tasks_of(spark) as counts:
        found = plans.QUERIES["session_inventory"](spark, SF_DIR)
    assert max(counts) > 1
    assert {r.input for r in found.collect()} == {"slices", "volume"}
    monkeypatch.setattr(plans, "tree", lambda t: many)
    monkeypatch.setattr(plans.readers, "session_inventory", lambda files, root: files)
    with tasks_of(spark) as counts:
        plans.QUERIES["session_inventory"](spark, SF_DIR)
    assert counts == [spark.sparkContext.defaultParallelism]


def test_sessions_below_a_root_with_a_scheme(spark, tmp_path, monkeypatch):
    """Spark writes file:/ where a URI has file:///; a store that only Spark opens gives the same sessions."""
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.sessions.link./in", f"file://{tmp_path}")
    want = sorted(plans.QUERIES["session_inventory"](spark, SF_DIR).collect())
    assert want
    for top in (f"file://{tmp_path}", f"file:{tmp_path}", "viewfs://sessions/in"):
        monkeypatch.setattr(plans, "_folder", lambda t, top=top: f"{top}/{uuid.uuid4().hex}")
        assert sorted(plans.QUERIES["session_inventory"](spark, SF_DIR).collect()) == want, top
    files = spark.createDataFrame([(p,) for p in ("hdfs://a/a/s/a/x/1.dcm", "hdfs://a/a/1/2/3/4/5/6/7/x/1.dcm", "hdfs://a/a/0/2.dcm")], "path string")
    assert {tuple(r) for r in readers.session_inventory(files, "hdfs://a/a/").collect()} == {("", "0", "slices")}
    assert {tuple(r) for r in readers.session_inventory(files.where("path not like '%2.dcm'"), "/a").collect()} == {("s/a", "s/a/x", "slices")}


def test_sessions_read_a_file_of_inventory_for_each_core(spark):
    """Not a task for each few of the tree's files, and that for each use of the inventory."""
    found = plans.QUERIES["session_inventory"](spark, SF_DIR)
    assert len(found.inputFiles()) <= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("pattern", ["*", "*.dcm", "?.dcm", "{1,2}.dcm", "[12].dcm"])
def test_tasks_list_what_spark_lists(spark, tmp_path, pattern):
    names = ("top.dcm", "a b%20é/1.dcm", "a b%20é/c/2.dcm", "_x/1.dcm", "_k=1/1.dcm", ".y/1.dcm", "a b%20é/.1.dcm", "a b%20é/_1.dcm", "1.dcm._COPYING_", "d/e/f/g/11.dcm")
    for name in names:
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_text(name)
    for k, path in enumerate((f"{tmp_path}/t", f"{tmp_path}/t/", f"file://{tmp_path}/t", f"{tmp_path}/t/top.dcm")):
        want = readers.scan_file_inventory(spark, path, pattern)
        found = readers.scan_file_inventory(spark, path, pattern, stage=f"{tmp_path}/stage{k}")
        assert found.dtypes == want.dtypes and (k == 3 or want.count())
        spent = lambda r: (*r[:2], r[2].replace(microsecond=r[2].microsecond // 1000 * 1000), *r[3:])  # noqa: E731  Spark has milliseconds
        assert sorted(map(spent, found.collect())) == sorted(map(spent, want.collect()))


def test_headers_are_opened_by_the_tasks_that_list(spark, many):
    with tasks_of(spark) as counts:
        found = readers.scan_scan_headers(spark, many + "/", lambda raw: {"raw": raw.decode()}, ["raw"])
    assert counts == [spark.sparkContext.defaultParallelism]  # no job for chosen paths, which the driver doesn't see
    assert {(r.folder, r.raw, r.n_slices, r.error) for r in found.collect()} == {(f"file:{many}/{k}", f'{{"block": {{"f": "{k}"}}}}', 1, None) for k in range(50)}


def test_headers_of_odd_paths(spark, tmp_path):
    """Endings, names with signs that patterns or URIs use, hidden files; and a store that only Spark opens."""
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.odd.link./in", f"file://{tmp_path}")
    for name, raw in (("a b%20é/1.gz", b"one"), ("a b%20é/2.gz", b"more"), ("c/_x/1", b"no"), ("c/.y", b"no"), ("c/z", b"z")):
        (tmp_path / "odd" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "odd" / name).write_bytes(raw)
    want = {("a b%20é", 2, "one"), ("c", 1, "z")}
    for path in (str(tmp_path / "odd"), f"file://{tmp_path}/odd/", "viewfs://odd/in/odd", f"{tmp_path}/od?"):
        found = readers.scan_scan_headers(spark, path, lambda raw: {"raw": raw.decode()}, ["raw"]).collect()
        assert {(r.folder.rpartition("/")[2], r.n_slices, r.raw) for r in found} == want and len(found) == 2, path
