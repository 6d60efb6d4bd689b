"""Incremental ingest with Structured Streaming: new result files, and verdicts of which the last per target counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import _file_system, append_resumable


def read_results(spark: SparkSession, path: str, schema, fmt: str = "parquet", files: int | None = None) -> DataFrame:
    """Stream of the files of a folder; at most ``files`` of them in a batch, if that is given."""
    reader = spark.readStream.schema(schema).format(fmt).option("header", True)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).load(path)


def stream_results_append(source: DataFrame, target: str, checkpoint: str, keys: list[str], time: str | None = None, delay: str = "1 day"):
    """Start a query that appends each key's first row; rows that come again add nothing, also after a restart.

    With ``time`` (the event's time column) the stream keeps the keys of the last ``delay`` of event time in its state and
    reads none of what is stored: state is bounded by the keys of that span, and the file sink's log makes batches that
    are run again write nothing. A key that comes again within ``delay`` is dropped; so is any row that is older than the
    newest by more than ``delay``, repeated or not, so ``delay`` must cover how late results come. Without ``time`` no row
    is too late, and each batch is compared with the keys stored in the target.
    """
    if time:
        new = source.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
        return new.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

    def append(batch: DataFrame, _: int) -> None:
        append_resumable(batch.dropDuplicates(keys), target, keys)

    return source.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Buckets that the keys of a table of last rows are dealt to, unless the caller says otherwise.
BUCKETS = 64


def stream_latest_verdict(source: DataFrame, target: str, checkpoint: str, keys: list[str], order: str, buckets: int = BUCKETS):
    """Start a query that keeps the last row per key in a table of hash buckets, of which a batch rewrites those only that
    hold its keys.

    Of equal ``order`` the row of the later batch counts (column ``arrival``), so late rows change nothing. A batch is
    cut to one row per key, meets the newest version of its buckets and writes their next one to
    ``version=<batch>/bucket=<k>``; a version counts once its ``_SUCCESS`` is there, so a crash leaves the old rows, and
    a batch that is run again replaces its own output. Buckets that an earlier batch superseded are then removed;
    readers of the version before stay whole. State is that table: it grows with the keys, not with time.
    """

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        place = F.pmod(F.xxhash64(*[F.col(c) for c in keys]), F.lit(buckets)).cast("int")
        value = F.struct(F.col(order), "arrival", *[F.col(c) for c in batch.columns if c not in (*keys, order)])
        last = lambda rows: rows.groupBy("bucket", *keys).agg(F.max(value).alias("_v")).select("bucket", *keys, "_v.*").select(*batch.columns, "arrival", "bucket")
        new = last(batch.withColumns({"arrival": F.lit(n).cast("long"), "bucket": place})).persist()
        try:
            touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
            if not touched:
                return
            have = newest_buckets(spark, target, before=n)
            old = [have[k] for k in touched if k in have]
            rows = new.unionByName(spark.read.option("basePath", target).parquet(*old).select(*new.columns)) if old else new
            last(rows.repartition(len(touched), "bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/version={n}")
        finally:
            new.unpersist()
        _drop_superseded(spark, target, n, have)

    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, target: str) -> list[tuple[int, dict[int, str]]]:
    """(version, bucket -> folder) of what has been written whole, oldest first."""
    hadoop, fs = _file_system(spark, target)
    found = []
    if fs.exists(hadoop(target)):
        for version in fs.listStatus(hadoop(target)):
            path = version.getPath()
            if path.getName().startswith("version=") and fs.exists(hadoop(f"{target}/{path.getName()}/_SUCCESS")):
                names = [b.getPath().getName() for b in fs.listStatus(path)]
                found.append((int(path.getName()[8:]), {int(b[7:]): f"{target}/{path.getName()}/{b}" for b in names if b.startswith("bucket=")}))
    return sorted(found)


def newest_buckets(spark: SparkSession, target: str, before: int | None = None) -> dict[int, str]:
    """Folder of each bucket's newest version (of those before a batch, if that is given)."""
    newest: dict[int, str] = {}
    for version, buckets in _versions(spark, target):
        if before is None or version < before:
            newest |= buckets
    return newest


def _drop_superseded(spark: SparkSession, target: str, n: int, kept: dict[int, str]) -> None:
    """Remove what was superseded before batch ``n``; what that batch superseded stays for readers and for a rerun."""
    for version, buckets in _versions(spark, target):
        if version < n:
            for k, path in buckets.items():
                if kept.get(k) != path:
                    _remove(spark, path)
            if all(kept.get(k) != path for k, path in buckets.items()):
                _remove(spark, f"{target}/version={version}")


def latest_rows(spark: SparkSession, target: str) -> DataFrame:
    """The last row per key that :func:`stream_latest_verdict` has written: each bucket's newest version."""
    return spark.read.option("basePath", target).parquet(*newest_buckets(spark, target).values()).drop("version", "bucket")


def stream_progress(source: DataFrame, target: str, checkpoint: str, subject: str, item: str):
    """Start a query that keeps (subject, done, total): how many of a subject's items have come so far.

    Each item is kept once, in a table of hash buckets like that of :func:`stream_latest_verdict`, so repeats and batches
    that are run again don't count twice, and a batch touches the buckets of its items only. Read by :func:`progress`.
    """
    items = source.select(subject, item).withColumn("_seen", F.lit(0))
    return stream_latest_verdict(items, target, checkpoint, [subject, item], "_seen")


def progress(spark: SparkSession, target: str, totals: DataFrame, subject: str) -> DataFrame:
    """(subject, done, total) of what :func:`stream_progress` has kept, against static totals."""
    done = latest_rows(spark, target).groupBy(subject).agg(F.count("*").alias("done"))
    return totals.join(done, subject, "left").select(subject, F.coalesce("done", F.lit(0)).alias("done"), "total")


def stream_error_backup(source: DataFrame, write: Callable[[DataFrame, int], None], backup: str, checkpoint: str):
    """Start a query that writes each batch by ``write``; a batch whose write fails goes to a folder of its own number
    under ``backup``, with the error, and the stream goes on. The number makes a repeated batch replace its own copy."""

    def guarded(batch: DataFrame, n: int) -> None:
        kept = batch.persist()
        try:
            write(kept, n)
        except Exception as e:  # noqa: BLE001  whatever the sink raises
            kept.withColumn("error", F.lit(f"{type(e).__name__}: {e}"[:500])).write.mode("overwrite").parquet(f"{backup}/batch={n}")
        finally:
            kept.unpersist()

    return source.writeStream.foreachBatch(guarded).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _remove(spark: SparkSession, path: str) -> None:
    hadoop, fs = _file_system(spark, path)
    fs.delete(hadoop(path), True)
