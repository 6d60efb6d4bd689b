"""Shared pieces of the text-pipeline operators: staged tables and skew-safe joins."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most this many keys can each hold 1/HOT_KEYS of all rows, so a table of such keys has a proven size bound.
HOT_KEYS = 1000
#: Rows in an Arrow batch: whole documents can be long, so batches are kept small.
BATCH_ROWS = 500

_STAGED: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset a local one is made, but
    only if the executors are on this machine."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="caseflow-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder; removed when this Python process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _STAGED.append((spark, path))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    spark, path = df.sparkSession, df._staged
    _STAGED.remove((spark, path))
    remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def release_staged() -> None:
    """Delete the staged tables of this process; frames that read them become unusable."""
    while _STAGED:
        spark, path = _STAGED.pop()
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may already be gone
            continue


atexit.register(release_staged)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound Python batches: whole texts can be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def join_counted(big: DataFrame, small: DataFrame, key: str | list[str], count: str, total: int, how: str = "inner", hot_keys: int = HOT_KEYS) -> DataFrame:
    """Join ``big`` to ``small`` (unique in ``key``) where a few keys may hold most of ``big``.

    ``small[count]`` is the number of rows of ``big`` with that key, ``total`` their sum. Keys with at least
    ``total / hot_keys`` rows (at most ``hot_keys`` of them) are joined by broadcast, the others by a shuffle.
    ``how`` is ``inner`` or ``left``.
    """
    limit = max(1, total // hot_keys)
    keys = [key] if isinstance(key, str) else key
    payload = small.drop(count)
    if total <= hot_keys:
        return big.join(payload, keys, how)
    hot = F.broadcast(payload.where(small[count] > limit))
    cold = payload.where(small[count] <= limit)
    return big.join(hot, keys).unionByName(big.join(hot.select(*keys), keys, "left_anti").join(cold, keys, how))


def place(df: DataFrame, name: str) -> int:
    """Position of a column: that of the very name (the first of several), or else the only one that differs by case."""
    exact = [k for k, c in enumerate(df.columns) if c == name] or [k for k, c in enumerate(df.columns) if c.lower() == name.lower()]
    if not exact:
        raise ValueError(f"missing column {name}; have {df.columns}")
    return exact[0]


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named by position, so that no name is ambiguous or clashes with a helper's."""
    return df.toDF(*[f"_{k}" for k in range(len(df.columns))])


def need(df: DataFrame, *names: str) -> DataFrame:
    """Project to the named columns; extra columns, whatever their names, are left behind."""
    at = [place(df, n) for n in names]
    return numbered(df).select(*[F.col(f"_{k}").alias(n) for k, n in zip(at, names, strict=True)])


def type_of(df: DataFrame, name: str) -> str:
    """Name of a column's type, for the schema of a Python step that passes the column on."""
    return df.schema[place(df, name)].dataType.simpleString()


def with_text(docs: DataFrame, text_col: str, fresh, extra: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with its text replaced by the field ``text`` of the struct column ``fresh(text)``, and with the fields
    ``extra`` (field -> column name) added; columns of those names that ``docs`` has are replaced. Order is kept."""
    extra, at = extra or {}, place(docs, text_col)
    kept = [k for k, c in enumerate(docs.columns) if c.lower() not in {n.lower() for n in extra.values()} or k == at]
    plain = numbered(docs)
    coded = plain.select(*[f"_{k}" for k in kept], fresh(F.col(f"_{at}").cast("string")).alias("_fresh"))
    out = coded.select(*[F.col("_fresh.text") if k == at else F.col(f"_{k}") for k in kept], *[F.col(f"_fresh.{f}") for f in extra])
    return out.toDF(*[docs.columns[k] for k in kept], *extra.values())


#: Bits of a membership filter: at most MARK_BITS / 8 bytes are ever broadcast, whatever the number of keys.
MARK_BITS = 1 << 25


def marks(keys: DataFrame, key: str | list[str]) -> DataFrame:
    """(bucket, bits) of a filter of fixed size over the hashes of ``keys``; combined before the shuffle."""
    bit = _bit(key)
    return keys.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))


def split_by_marks(df: DataFrame, key: str | list[str], filt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` in two: rows whose key may be in the filter (some of them aren't), and rows whose key surely isn't.

    So that a join needs to shuffle the former only."""
    place = F.bitmap_bit_position(_bit(key))
    byte = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    marked = df.withColumn("bucket", F.bitmap_bucket_number(_bit(key))).join(F.broadcast(filt), "bucket", "left").withColumn("_hit", hit).drop("bucket", "bits")
    return marked.where("_hit").drop("_hit"), marked.where("not _hit").drop("_hit")


def _bit(key: str | list[str]):
    return F.pmod(F.xxhash64(*([key] if isinstance(key, str) else key)), F.lit(MARK_BITS)) + 1
