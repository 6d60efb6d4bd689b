"""WARC archives: a distributed writer with revisit records, and a reader that salvages damaged archives.

The writer makes each record a gzip member (or a plain string) and lets Spark's text writer put them into files, so
archives go to any file system that Spark writes to, under its commit protocol. The reader takes archives of plain records, of a gzip
member for each record, or of one member for all. Where a member or a record fails its checks it searches for the
next valid member or version line, goes on from there, and logs the gap of bytes that it left out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fresh_path, join_counted, marks, need, small_batches, split_by_marks, stage

#: Records in an archive file at most, for payloads of at most so many bytes: a file fits into a reading task. Larger
#: payloads have files of at most FILE_BYTES, or of one record.
FILE_RECORDS, FILE_BYTES = ((1 << 16, 2_000), (1 << 20, 128)), 1 << 27
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"
_END = b"\r\n\r\n"
_BLANK = re.compile(r"[\s\x00-\x1f\x7f]")
#: Bytes of a member that are decompressed at a time, first and at most.
STEP, STEPS = 1 << 12, 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass
class Record:
    """One salvaged record: its headers (lower-case names), its block, and where it lay."""

    headers: dict[str, str]
    block: bytes
    start: int
    end: int

    @property
    def http(self) -> tuple[dict[str, str], bytes]:
        head, _, body = self.block.partition(_END)
        lines = head.decode("utf-8", "replace").split("\r\n")[1:]
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, body


@dataclass
class Gap:
    """Bytes of an archive that belong to no valid record."""

    start: int
    end: int
    reason: str


def _parse(data: bytes, at: int) -> Record | str:
    """Record at ``at``, or why there is none."""
    m = _VERSION.match(data, at)
    if not m:
        return "no version line"
    stop = data.find(_END, m.end() - 2)
    if stop < 0:
        return "headers without an end"
    headers = {}
    for line in data[m.end() : stop].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            return "malformed header"
        headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not length.isdigit():
        return "no content length"
    start, end = stop + len(_END), stop + len(_END) + int(length)
    if data[end : end + len(_END)] != _END:
        return "content length doesn't lead to the record's end"
    block = data[start:end]
    for name, part in (("warc-block-digest", block), ("warc-payload-digest", None)):
        given = headers.get(name, "")
        if given.startswith("sha1:") and not (name == "warc-payload-digest" and headers.get("warc-type") == "revisit"):
            if part is None:
                part = block.partition(_END)[2] if block.startswith(b"HTTP/") else block
            if base32_sha1(part) != given[5:].upper():
                return f"{name} doesn't match"
    return Record(headers, block, at, end + len(_END))


def salvage_records(data: bytes) -> Iterator[Record | Gap]:
    """Records of an uncompressed archive in order, and the gaps between them."""
    at = 0
    while at < len(data):
        found = _parse(data, at)
        if isinstance(found, Record):
            at = found.end  # before the record is handed out: its holder may move its offsets
            yield found
            continue
        start, reason = at, found
        while isinstance(found, str):  # the next version line that begins a valid record
            m = _VERSION.search(data, at + 1)
            if not m:
                at = len(data)
                break
            at = m.start()
            found = _parse(data, at)
        yield Gap(start, at, reason)


def _inflate(data: bytes, at: int, rest: bool) -> tuple[bytes, int, str]:
    """(content, end, fault) of the member at ``at``: with a fault and ``rest``, what came out before it.

    Steps grow with the member, so the bytes behind its end that a step copies are at most about as many as its own.
    """
    view, d, out, place, step = memoryview(data), zlib.decompressobj(31), [], at, STEP
    try:
        while not d.eof and place < len(data):
            out.append(d.decompress(view[place : place + step]))
            place, step = place + step, min(2 * step, STEPS)
    except zlib.error as e:
        if not rest:
            return b"", at, str(e)
        d = zlib.decompressobj(31)
        out = [d.decompress(view[at:place])]
        for k in range(place, min(place + step, len(data))):  # byte by byte
            try:
                out.append(d.decompress(view[k : k + 1]))
            except zlib.error:
                break
        return b"".join(out), at, str(e)
    return b"".join(out), min(place, len(data)) - len(d.unused_data), "" if d.eof else "member without an end"


def _members(data: bytes) -> Iterator[tuple[int, int, bytes, str]]:
    """(start, end, content, fault) of gzip members and of the bytes between them, in order.

    A faulty member ends where the next sound one begins, and its content is what came before the fault.
    """
    at = 0
    while at < len(data):
        start, content, reason = at, b"", ""
        sound = None
        while at < len(data):
            if data.startswith(_MEMBER, at):
                part, end, fault = _inflate(data, at, at == start)
                if not fault:
                    sound = at, end, part, ""
                    break
                reason = reason or fault
                if at == start:
                    content = part
            nxt = data.find(_MEMBER, at + 1)
            at = len(data) if nxt < 0 else nxt
        if at > start:
            yield start, at, content, reason or "no member"
        if sound:
            yield sound
            at = sound[1]


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Records and gaps of an archive, plain or gzip. Offsets in a gzip archive are those of the members.

    Of a faulty member the records that end before the fault are kept, not one that reaches it, and the member is a gap
    besides.
    """
    if not data.startswith(_MEMBER) and (_VERSION.search(data) or _MEMBER not in data):
        found = list(salvage_records(data))
        if _MEMBER not in data or any(isinstance(r, Record) for r in found):
            yield from found
            return
    for start, end, content, fault in _members(data):
        if fault:
            for r in salvage_records(content):
                if isinstance(r, Record) and r.end < len(content):
                    r.start, r.end = start, end
                    yield r
            yield Gap(start, end, fault)
            continue
        for r in salvage_records(content):
            r.start, r.end = start, end
            yield r


def _member(record: bytes) -> bytes:
    """Gzip member without its last byte, which is 0: the top of the size, or of an empty member's after a large record."""
    out = gzip.compress(record, 6, mtime=0)
    return (out if len(record) < 1 << 24 else out + gzip.compress(b"", mtime=0))[:-1]


def compress_records(records: list[bytes]) -> bytes:
    """A gzip member for each record."""
    return b"".join(gzip.compress(r, mtime=0) for r in records)


# ------------------------------------------------------------------ writing


def payload_digests(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url") -> DataFrame:
    """(id, html, url, sha1 hex, bytes): a null payload is an empty one; the url is null if there is no such column."""
    names = [id_col, payload_col, *([url_col] if url_col in pages.columns else [])]
    rows = need(pages, *names).toDF(*["id", "html", "url"][: len(names)])
    rows = rows.withColumns({"id": F.col("id").cast("long"), "html": F.coalesce(F.col("html").cast("string"), F.lit("")), "url": (F.col("url") if len(names) > 2 else F.lit(None)).cast("string")})
    return rows.withColumns({"sha1": F.sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html")})


def plan_records(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url") -> DataFrame:
    """(id, html, url, sha1, bytes, refers_to): of equal payloads of at least ``least_bytes`` bytes the largest id responds.

    Payloads are equal if their SHA-1 and size are. A null id refers to the group's largest id, if there is one. Ids are
    whole numbers. Only digests are grouped, combined before the shuffle; pages whose digest no other page has pass by
    the join, so their payloads aren't shuffled, and groups that hold very many pages are joined by broadcast.
    """
    rows = payload_digests(pages, id_col, payload_col, url_col).withColumn("key", F.concat_ws("-", "sha1", F.col("bytes").cast("string")))
    groups = rows.groupBy("key").agg(F.max("id").alias("last"), F.count("*").alias("n"), F.max("bytes").alias("size"))
    repeated = stage(groups.where((F.col("n") > 1) & (F.col("size") >= least_bytes)).select("key", "last", "n"), "digests")
    total = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    some, rest = split_by_marks(rows, "key", marks(repeated, "key"))
    joined = join_counted(some, repeated, "key", "n", total, "left").unionByName(rest, allowMissingColumns=True)
    return joined.withColumn("refers_to", F.when(F.col("id").eqNullSafe(F.col("last")), None).otherwise(F.col("last"))).drop("key", "last")


def write_warc(plan: DataFrame, path: str, compress: bool = True, largest: int | None = None) -> None:
    """Write a record per row of ``plan`` (see :func:`plan_records`) to archives in ``path``; a gzip member for each.

    Payloads of about one size share files, so that no file is larger than a task can read; ``largest`` is the size of
    the largest one, if it is known.
    """
    small_batches(plan.sparkSession)

    @F.pandas_udf("binary")
    def record(ids: pd.Series, html: pd.Series, urls: pd.Series, sha1: pd.Series, sizes: pd.Series, refers: pd.Series) -> pd.Series:
        out = []
        for i, text, url, digest, size, ref in zip(ids, html, urls, sha1, sizes, refers, strict=True):
            known, revisit = not pd.isna(i), not pd.isna(ref)
            name = f"urn:page:{int(i)}" if known else "urn:page:none"
            url = "" if pd.isna(url) else _BLANK.sub(lambda m: quote(m.group()), url)  # a header is one line
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {int(size)}\r\n\r\n"
            block = head if revisit else head + text
            lines = [
                "WARC/1.1",
                f"WARC-Type: {'revisit' if revisit else 'response'}",
                f"WARC-Record-ID: <{name}>",
                f"WARC-Target-URI: {url or name}",
                "WARC-Date: 1970-01-01T00:00:00Z",  # pages have no capture time; a constant keeps rewrites equal
                f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
                "Content-Type: application/http; msgtype=response",
                f"Content-Length: {len(head) + (0 if revisit else int(size))}",
            ]
            if revisit:
                lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{int(ref)}>"]
            whole = ("\r\n".join(lines) + "\r\n\r\n" + block).encode()
            out.append(_member(whole + _END) if compress else whole)
        return pd.Series(out)

    html = F.when(F.col("refers_to").isNull(), F.col("html")).otherwise(F.lit(""))
    rows = plan.select("bytes", record("id", html, "url", "sha1", "bytes", F.col("refers_to")).cast("string").alias("value"))
    limits = [0, *(most for most, _ in FILE_RECORDS)]
    largest = (plan.agg(F.max("bytes")).first()[0] or 0) if largest is None else largest
    counts = [n for _, n in FILE_RECORDS] + [max(1, FILE_BYTES // max(1, largest))]
    for low, high, n in zip(limits, [*limits[1:], None], counts, strict=True):
        if not low or largest > low:
            part = rows.where((F.col("bytes") > low if low else F.lit(True)) & (F.col("bytes") <= high if high else F.lit(True))).select("value")
            # the separator ends a plain record, or is the last byte of a member
            part.write.mode("append").option("lineSep", "\0" if compress else "\r\n\r\n").option("maxRecordsPerFile", n).option("compression", "none").text(path)
            _drop_empty(plan.sparkSession, path)


def _drop_empty(spark: SparkSession, path: str) -> None:
    """Spark's writers make a file for a first partition without rows; an archive of no bytes is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for file in fs.globStatus(hadoop(f"{path}/part-00000-*")):
        if not file.getLen():
            fs.delete(file.getPath(), False)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, end, page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload, gap) of all archives.

    A row is a record (gap null) or a quarantined gap (record columns null, gap the reason). A revisit's size is that
    of the HTTP header it repeats, its payload is null. Archives are read whole, one at a time in a task.
    """
    small_batches(spark)  # a row is a whole archive; a task's rows are bounded by spark.sql.files.maxPartitionBytes
    schema = "file string, start long, `end` long, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, gap string"
    number = re.compile(r"<urn:page:(-?\d+)>").fullmatch

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                rows: list[tuple] = []
                for r in salvage(bytes(content)):
                    if isinstance(r, Gap):
                        rows.append((file, r.start, r.end, *[None] * 7, r.reason))
                        continue
                    http, body = r.http
                    kind = r.headers.get("warc-type")
                    page, ref = (number(r.headers.get(x, "")) for x in ("warc-record-id", "warc-refers-to"))
                    size = len(body) if kind != "revisit" else int(http.get("content-length", "0"))
                    digest = r.headers.get("warc-payload-digest", "").removeprefix("sha1:")
                    rows.append((file, r.start, r.end, page and int(page[1]), r.headers.get("warc-target-uri"), kind, ref and int(ref[1]), digest, size, None if kind == "revisit" else body, None))
                    if len(rows) >= 500:
                        yield _frame(rows)
                        rows = []
                yield _frame(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(read, schema)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["file", "start", "end", "page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload", "gap"])
    return out.astype({c: "Int64" for c in ("start", "end", "page_id", "refers_to", "payload_bytes")})


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write ``pages`` to archives and read them back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    A null payload is an empty one, a payload of any length that a row holds is written whole, pages of equal id and
    payload are both responses, extra columns are left behind, and an empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    largest = payload_digests(pages, id_col, payload_col).agg(F.coalesce(F.max("bytes"), F.lit(0))).first()[0]
    write_warc(plan_records(pages, least_bytes, id_col, payload_col), path, largest=largest)
    back = read_warc(spark, path).where("gap is null")
    return back.select(F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")
