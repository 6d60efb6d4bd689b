"""Streams over several batches and restarts: what they write, what they touch, and what they keep."""

from __future__ import annotations

import datetime
import os

from pyspark.sql import functions as F

from caseflow.streaming import results as S

SCHEMA = "k int, ts timestamp, v string"


def put(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def at(hours):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hours)


def folders(path):
    return {f"{v}/{b}" for v in os.listdir(path) if v.startswith("version=") for b in os.listdir(f"{path}/{v}") if b.startswith("bucket=")}


def test_latest_rows_touch_their_buckets_only(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    run = lambda: S.stream_latest_verdict(S.read_results(spark, src, SCHEMA, files=1), out, check, ["k"], "ts", buckets=8).awaitTermination()
    place = {r.k: r.b for r in spark.range(40).select(F.col("id").cast("int").alias("k")).select("k", F.pmod(F.xxhash64("k"), F.lit(8)).alias("b")).collect()}
    put(spark, src, [(k, at(1), "one") for k in range(40)])
    run()
    first = folders(out)
    assert first == {f"version=0/bucket={b}" for b in set(place.values())}
    put(spark, src, [(3, at(2), "two"), (3, at(0), "late"), (5, at(0), "late")])
    run()  # a restart: another query on the same checkpoint
    assert folders(out) - first == {f"version=1/bucket={place[k]}" for k in (3, 5)}
    put(spark, src, [(3, at(2), "two"), (7, at(1), "tie")])  # a repeated row, and one of equal time in a later batch
    run()
    touched = {f"version=2/bucket={place[k]}" for k in (3, 7)}
    assert touched <= folders(out) and not {f for f in folders(out) if f.startswith("version=2")} - touched
    got = {r.k: (r.v, r.arrival) for r in S.latest_rows(spark, out).collect()}
    assert got == {k: ("one", 0) for k in range(40)} | {3: ("two", 2), 7: ("tie", 2)}


def test_a_batch_that_breaks_off_is_run_again(spark, tmp_path):
    """A version without its mark doesn't count; the batch that is run again writes it whole."""
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    run = lambda: S.stream_latest_verdict(S.read_results(spark, src, SCHEMA, files=1), out, check, ["k"], "ts", buckets=4).awaitTermination()
    put(spark, src, [(1, at(1), "a"), (2, at(1), "b")])
    run()
    put(spark, src, [(1, at(2), "c")])
    run()
    os.remove(f"{out}/version=1/_SUCCESS")
    os.remove(f"{check}/commits/1")
    for crc in (f"{check}/commits/.1.crc",):
        if os.path.exists(crc):
            os.remove(crc)
    assert {r.k: r.v for r in S.latest_rows(spark, out).collect()} == {1: "a", 2: "b"}
    run()
    assert {r.k: r.v for r in S.latest_rows(spark, out).collect()} == {1: "c", 2: "b"}


def test_appends_keep_bounded_state_over_time(spark, tmp_path):
    """Each day repeats half of the day before; state holds the days within the delay, not all."""
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    kept = []
    for day in range(8):
        put(spark, src, [(100 * day + i, at(24 * day + i / 100), "x") for i in range(-50, 100)])
        query = S.stream_results_append(S.read_results(spark, src, SCHEMA, files=1), out, check, ["k"], "ts", "36 hours")
        query.awaitTermination()
        kept.append(max(s.numRowsTotal for p in query.recentProgress for s in p.stateOperators))
    got = [r.k for r in spark.read.parquet(out).collect()]
    assert len(got) == len(set(got)) == 850
    assert max(kept[2:]) <= 450 and kept[-1] <= kept[2] + 50


def test_appends_without_time_take_any_late_row(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    for rows in ([(1, at(100), "a")], [(2, at(0), "late"), (1, at(100), "again")]):
        put(spark, src, rows)
        S.stream_results_append(S.read_results(spark, src, SCHEMA, files=1), out, check, ["k"]).awaitTermination()
    assert sorted((r.k, r.v) for r in spark.read.parquet(out).collect()) == [(1, "a"), (2, "late")]


def test_progress_counts_items_once(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    totals = spark.createDataFrame([("s", 3), ("t", 2)], "v string, total int")
    for rows in ([(1, at(0), "s"), (2, at(0), "s")], [(2, at(1), "s"), (3, at(1), "s")], [(1, at(2), "s")]):
        put(spark, src, rows)
        S.stream_progress(S.read_results(spark, src, SCHEMA, files=1), out, check, "v", "k").awaitTermination()
    assert {tuple(r) for r in S.progress(spark, out, totals, "v").collect()} == {("s", 3, 3), ("t", 0, 2)}
