from __future__ import annotations

import gzip
import random
import time

import numpy as np
import pytest

from caseflow.llm import ann, warc

SF = "/root/testdata/sf0.01"


def record(i: int, html: bytes) -> bytes:
    block = f"HTTP/1.1 200 OK\r\nContent-Length: {len(html)}\r\n\r\n".encode() + html
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Payload-Digest: sha1:{warc.base32_sha1(html)}\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


RECORDS = [record(i, b"<p>%d</p>\r\n\r\nWARC/1.1\r\n" % i * (i % 5)) for i in range(40)]


def split(data: bytes):
    found = list(warc.salvage(data))
    return [r.headers["warc-record-id"] for r in found if isinstance(r, warc.Record)], [g for g in found if isinstance(g, warc.Gap)]


@pytest.mark.parametrize("pack", [b"".join, warc.compress_records, lambda r: gzip.compress(b"".join(r))])
def test_sound_archives(pack):
    ids, gaps = split(pack(RECORDS))
    assert ids == [f"<urn:page:{i}>" for i in range(40)] and not gaps


def test_damaged_plain_archive():
    parts = list(RECORDS)
    parts[7] = parts[7].replace(b"<p>7", b"<q>7")  # digest fails
    parts[20] = parts[20][:-30]  # cut short
    data = b"junk" + b"".join(parts) + b"WARC/1.1\r\nhalf"
    ids, gaps = split(data)
    assert ids == [f"<urn:page:{i}>" for i in range(40) if i not in (7, 20)]
    assert sum(g.end - g.start for g in gaps) == len(data) - sum(len(p) for k, p in enumerate(parts) if k not in (7, 20))


def test_damaged_gzip_archive():
    members = [warc.compress_records([r]) for r in RECORDS]
    members[11] = members[11][:25] + b"\0\0\0" + members[11][28:]
    data = b"".join(members)[:-5]
    ids, gaps = split(data)
    assert ids == [f"<urn:page:{i}>" for i in range(39) if i != 11]
    assert gaps[0].start == sum(map(len, members[:11])) and gaps[-1].end == len(data)


def test_random_damage_never_fails():
    rng, data = random.Random(1), bytearray(b"".join(RECORDS))
    for _ in range(30):
        bad = bytearray(data)
        for _ in range(5):
            at = rng.randrange(len(bad))
            bad[at : at + rng.randrange(40)] = rng.randbytes(rng.randrange(40))
        found = list(warc.salvage(bytes(bad)))
        assert found[-1].end <= len(bad) and sum(isinstance(r, warc.Record) for r in found) >= 25


@pytest.mark.parametrize("least", [0, 4])
def test_round_trip(spark, least):
    rows = [(1, "aé"), (2, "aé"), (3, None), (4, ""), (5, "long text\r\n\r\nWARC/1.1\r\n" * 9), (6, "long text\r\n\r\nWARC/1.1\r\n" * 9), (None, "solo"), (6, "long text\r\n\r\nWARC/1.1\r\n" * 9)]
    df = spark.createDataFrame([(i, h, "u") for i, h in rows], "page_id long, html string, id string")
    got = sorted((tuple(r) for r in warc.archive_round_trip(df, least_bytes=least).collect()), key=repr)
    want = []
    for i, h in rows:
        raw = (h or "").encode()
        last = max((j for j, x in rows if (x or "") == (h or "") and j is not None), default=None)
        own = len(raw) < least or last == i
        want.append((i, len(raw), warc.base32_sha1(raw), "response" if own else "revisit", None if own else last))
    assert got == sorted(want, key=repr)
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_damage_in_the_writers_own_archives(spark, tmp_path):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, f"page {i} {rng.random()}" * 20) for i in range(60)], "page_id long, html string").coalesce(1)
    warc.write_warc(warc.plan_records(df), f"{tmp_path}/w")
    whole = {p.name: p.read_bytes() for p in (tmp_path / "w").glob("part-*")}
    assert sorted(x for data in whole.values() for x in split(data)[0]) == sorted(f"<urn:page:{i}>" for i in range(60))
    assert sum(gzip.decompress(data).count(b"WARC-Record-ID") for data in whole.values()) == 60
    data = max(whole.values(), key=len)
    ids, at = split(data)[0], data.index(b"\x1f\x8b\x08", len(data) // 2) + 60
    for bad in (data[:at] + bytes([data[at] ^ 255]) + data[at + 1 :], data[:-9], data[:at] + data[at + 3 :]):
        got, gaps = split(bad)
        assert len(got) >= len(ids) - 1 and gaps


def test_gaps_come_out_of_spark(spark, tmp_path):
    """A flipped byte in a written archive loses its record alone, and the reader logs it."""
    df = spark.createDataFrame([(i, f"<p>{i}</p>" * 200, f"http://x/{i} \r\nb") for i in range(50)], "page_id long, html string, url string").coalesce(1)
    warc.write_warc(warc.plan_records(df), f"{tmp_path}/w")
    part, *others = (tmp_path / "w").glob("part-*")
    assert not others  # nor an archive of no bytes
    data = bytearray(part.read_bytes())
    data[data.index(b"\x1f\x8b\x08", len(data) // 2) + 40] ^= 255
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.warc.gz").write_bytes(data)
    rows = warc.read_warc(spark, f"{tmp_path}/bad").collect()
    assert len([r for r in rows if r.gap is None]) == 49 and len([r for r in rows if r.gap]) == 1
    assert all(r.url == f"http://x/{r.page_id}%20%0D%0Ab" and r.payload == f"<p>{r.page_id}</p>".encode() * 200 for r in rows if r.gap is None)


def test_large_payloads_have_files_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", ((100, 20), (1000, 5)))
    monkeypatch.setattr(warc, "FILE_BYTES", 6000)
    rows = [(i, "x" * (50 if i < 60 else 900 if i < 90 else 3000) + str(i)) for i in range(96)]
    df = spark.createDataFrame(rows, "page_id long, html string").coalesce(1)
    warc.write_warc(warc.plan_records(df), f"{tmp_path}/w")
    per_file = [[len(r.payload) for r in warc.read_warc(spark, str(p)).collect()] for p in (tmp_path / "w").glob("part-*")]
    assert sorted((max(x) // 1000, len(x)) for x in per_file if x) == [(0, 5)] * 6 + [(0, 20)] * 3 + [(3, 1)] * 6
    assert sorted(n for x in per_file for n in x) == sorted(len(t) for _, t in rows)


def test_reading_members_takes_linear_time():
    members = [warc.compress_records([r]) for r in RECORDS] * 500
    took = []
    for n in (5_000, 20_000):
        data = b"".join(members[:n])
        began = time.process_time()
        assert sum(1 for _ in warc.salvage(data)) == n
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0]


def test_large_record_ends_its_member():
    data = warc._member(b"x" * (1 << 24)) + b"\0" + warc._member(b"y") + b"\0"
    assert gzip.decompress(data) == b"x" * (1 << 24) + b"y"


def test_records_before_a_fault_are_kept():
    rng = random.Random(2)
    records = [record(i, rng.randbytes(3000)) for i in range(100)]
    data = gzip.compress(b"".join(records))
    for bad in (data[: len(data) // 2], data[: len(data) // 2] + b"\xff" * 40 + data[len(data) // 2 + 40 :]):
        ids, gaps = split(bad)
        assert ids[:48] == [f"<urn:page:{i}>" for i in range(48)] and gaps[-1].end == len(bad)


def test_plain_archive_with_a_damaged_start():
    records = [record(i, b"a\x1f\x8b\x08b") for i in range(9)]
    ids, gaps = split(b"XX" + b"".join(records)[2:])
    assert ids == [f"<urn:page:{i}>" for i in range(1, 9)] and len(gaps) == 1


def exact(ids, m, step=50, k=5):
    u = m / np.linalg.norm(m, axis=1)[:, None]
    for q in np.nonzero(ids % step == 0)[0]:
        s = u @ u[q]
        s[ids == ids[q]] = -9
        yield int(ids[q]), ids[np.lexsort((ids, -s.round(12)))[:k]].tolist()


def test_recall(spark):
    t = spark.read.parquet(f"{SF}/embeddings.parquet")
    pdf = t.toPandas()
    got = {}
    for r in sorted(ann.nearest(t).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = dict(exact(pdf["vec_id"].to_numpy(), np.stack(pdf["embedding"]).astype(float)))
    assert got.keys() == want.keys()
    assert sum(len(set(got[q]) & set(want[q])) for q in want) / (5 * len(want)) >= 0.9


def test_small_clusters_give_k_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF_ROWS", 3)
    rng = np.random.default_rng(3)
    centres = np.repeat(rng.normal(size=(200, 8)), 3, axis=0)
    rows = [(i, v.tolist()) for i, v in enumerate(centres + rng.normal(size=centres.shape) / 1000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, recall=0.3).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert got.keys() == set(range(0, 600, 50)) and {len(v) for v in got.values()} == {5}


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0]), (9, [1.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ann.nearest(df).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.0)]
    assert ann.nearest(df.where("vec_id = 9")).count() == 0
    two = spark.createDataFrame([(0, [1e200, 0.0]), (1, [1e200, 1e200]), (50, [1e-200, 1.0, 0.0]), (51, [0.0, 2.0, 0.0]), (52, [1.0, 1.0, 1.0])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ann.nearest(two).collect()}
    assert got == {(0, 1, 1, 0.707106781), (50, 1, 51, 1.0), (50, 2, 52, 0.577350269)}
    assert ann.nearest(df.limit(0)).count() == 0


def test_copies_beyond_k(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(200)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert {q: sorted(v) for q, v in got.items()} == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4], 100: [0, 1, 2, 3, 4], 150: [0, 1, 2, 3, 4]}
