"""Scans: text tables, JSON documents, file inventories and per-scan headers."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from fnmatch import fnmatch, fnmatchcase
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql import types as T

#: Names that an id column may have, in the order in which they are tried.
ID_NAMES = ("subject", "case", "patient_id", "patientid", "paciente", "id")


@contextmanager
def _listed_in_runs(spark: SparkSession) -> Iterator[None]:
    """Loads within it list folders in a task for each core, not in up to 10,000 tasks of a folder or so each."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    old = spark.conf.get(key)
    spark.conf.set(key, min(int(old), spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def opened_by_uri(path: str) -> bool:
    """Whether tasks can open what is below ``path`` by its URI: Arrow knows the store, and the path has no pattern or
    escape, which Spark and Arrow read differently."""
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(path)
    except (ValueError, OSError, NotImplementedError):
        return False
    return not any(c in path for c in "*?[{\\%")


def scan_all_string(spark: SparkSession, path, columns: list[str] | None = None, sep: str = ",") -> DataFrame:
    """CSV with every column text and blanks for missing values; no inference pass."""
    reader = spark.read.option("header", True).option("sep", sep).option("escape", "\"")  # doubled quotes, as spreadsheets write them
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    df = reader.csv(path)
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def scan_text_keys(df: DataFrame, key: str) -> DataFrame:
    """Fails, when it runs, on an id that some program has rounded (an exponent or a point)."""
    bad = F.col(key).cast("string").rlike("[eE.]")
    return df.where(F.when(bad, F.raise_error(F.concat(F.lit("rounded id "), F.col(key).cast("string"))).cast("boolean")).otherwise(True))


def scan_many_with_source(spark: SparkSession, paths: list[str], source: str = "__source", name: str = r"([^/]+)/[^/]+$") -> DataFrame:
    """CSV files of differing headers read as text and put together by name, with the file that each row came from.

    ``name`` is a pattern whose group is the source's name in the file's path; columns that a file lacks are null.
    """
    parts = [spark.read.option("header", True).csv(p).select("*", F.regexp_extract("_metadata.file_path", name, 1).alias(source)) for p in paths]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def scan_ragged(spark: SparkSession, path: str, names: list[str], header: bool = True) -> DataFrame:
    """CSV whose rows have extra trailing fields, few or many: the first ones by the given names, absent ones null."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.option("header", header).option("enforceSchema", True).option("mode", "PERMISSIVE").schema(schema).csv(path)


def scan_json_docs(spark: SparkSession, path: str, block: str, entity: str = r"([^/]+?)(?:\.[^./]*)?$") -> DataFrame:
    """(id, feature, values): one JSON document a file, the block under ``block`` as a row for each of its keys.

    ``entity`` is a pattern whose group is the id in the file's path: its stem, unless given. A value may be a scalar or
    a list; a document without the block, or that is no JSON, gives no row.
    """
    with _listed_in_runs(spark):
        text = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    features = F.from_json(F.get_json_object("value", f"$.{block}"), "map<string,string>")
    rows = text.select(F.regexp_extract("_metadata.file_path", entity, 1).alias("id"), F.explode(features).alias("feature", "v"))
    return rows.select("id", "feature", F.when(F.col("v").startswith("["), F.from_json("v", "array<string>")).otherwise(F.array("v")).alias("values"))


def scan_fold_metrics(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(fold, case, dice, n_pred, n_ref, ratio) of summary files with an array of cases: a document a file, or a line.

    The fold is in the file's path; a fold may have any number of files.
    """
    schema = "metric_per_case array<struct<case:string,dice:double,n_pred:double,n_ref:double>>"
    df = spark.read.schema(schema).option("multiLine", multi_line).option("recursiveFileLookup", True).json(path)
    rows = df.select(F.regexp_extract("_metadata.file_path", r"fold_(\d+)", 1).cast("int").alias("fold"), F.explode("metric_per_case").alias("m")).select("fold", "m.*")
    return rows.withColumn("ratio", F.try_divide("n_pred", F.nullif("n_ref", F.lit(0.0))))


def included_ids(df: DataFrame, position: str, candidates: tuple[str, ...] = ID_NAMES, column: str | None = None) -> DataFrame:
    """(id, first): distinct non-blank ids and where each is first seen, from the given column or else the first of the
    candidate names that ``df`` has in any case; neither is an error."""
    lower = {c.lower(): c for c in df.columns}
    column = column if column is not None else next((lower[c] for c in candidates if c in lower), None)
    if column not in df.columns:
        raise ValueError(f"no id column among {df.columns}")
    ids = df.select(F.trim(F.col(f"`{column}`").cast("string")).alias("id"), F.col(position).alias("first")).where("id <> ''")
    return ids.groupBy("id").agg(F.min("first").alias("first"))


def series_manifest(series: DataFrame, masks: DataFrame, keys: list[str], name: str, number: str, shape: str, every: bool) -> DataFrame:
    """A row per volume of each series: (keys, series, number, volume, mask).

    Trailing axes of size 1 don't count. A series with a real fourth axis keeps its first volume alone, or with
    ``every`` all of them, named ``_v<t>`` and numbered ``number * 100 + t``. Its mask, if ``masks(keys, name, mask)``
    has one, goes to the first volume.
    """
    volumes = F.when(F.size(shape) > 3, F.greatest(F.element_at(shape, 4), F.lit(1))).otherwise(F.lit(1))
    rows = series.select(*keys, name, number, volumes.alias("_n"))
    rows = rows.withColumn("volume", F.explode(F.sequence(F.lit(0), F.col("_n") - 1 if every else F.lit(0))))
    split = (F.col("_n") > 1) & F.lit(every)
    named = rows.join(masks.select(*keys, name, "mask"), [*keys, name], "left")
    return named.select(
        *keys, F.when(split, F.concat(F.col(name), F.lit("_v"), "volume")).otherwise(F.col(name)).alias("series"),
        F.when(split, F.col(number) * 100 + F.col("volume")).otherwise(F.col(number)).alias("number"), "volume", F.when(F.col("volume") == 0, F.col("mask")).alias("mask"),
    )


def scan_feature_config(rows: DataFrame) -> DataFrame:
    """(feature, modality, plane, margin, top_k): a row per feature, modality and plane of a flat configuration.

    ``rows`` has text columns feature_name, modality and plane, planes joined by ; or |. Margin and top_k belong to the
    feature: the last value given in its rows, by ``line``, and 1 slice if none is.
    """
    planes = F.filter(F.transform(F.split("plane", "[;|]"), lambda x: F.trim(x)), lambda x: x != "")
    given = rows.select(F.trim("feature_name").alias("feature"), F.trim("modality").alias("modality"), "line", F.nullif("crop_margin_mm", F.lit("")).try_cast("double").alias("m"), F.nullif("top_k", F.lit("")).try_cast("int").alias("k"), planes.alias("planes"))
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("line", c)))[c]
    per = given.groupBy("feature").agg(last("m").alias("margin"), F.coalesce(last("k"), F.lit(1)).alias("top_k"))
    return given.select("feature", "modality", F.explode("planes").alias("plane")).join(per, "feature")


def scan_embeddings(spark: SparkSession, paths: list[str], key: str, label: str, vector: str) -> DataFrame:
    """Shards of embeddings put together; fails, when it runs, if they don't have the same set of labels.

    Every shard gives its sorted labels, one row; the check compares these rows alone."""
    parts = [spark.read.parquet(p).select(F.lit(i).alias("shard"), key, label, F.col(vector).cast("array<double>").alias(vector)) for i, p in enumerate(paths)]
    rows = reduce(DataFrame.unionByName, parts)
    lists = rows.groupBy("shard").agg(F.array_sort(F.collect_set(label)).alias("_l")).agg(F.collect_set("_l").alias("_l"))
    same = F.when(F.size("_l") > 1, F.raise_error(F.concat(F.lit("shards have different labels: "), F.to_json("_l"))).cast("boolean")).otherwise(True)
    return rows.crossJoin(F.broadcast(lists)).where(same).drop("_l")  # a single row


def scan_file_inventory(spark: SparkSession, path: str, pattern: str = "*", depth_names: tuple[str, ...] = ("subject", "session", "scan", "file"), stage: str | None = None) -> DataFrame:
    """(path, length, modificationTime, subject, session, scan, file) of a tree; contents aren't read.

    With ``stage``, a new folder that driver and executors share, the inventory is written there once and read from it, so
    that queries that need it several times don't plan a task for every few files each time. Tasks list the tree then, if
    they can by URI, and the driver holds no list of files; this shows files of no bytes too.
    """
    if stage and opened_by_uri(path) and not any(c in pattern for c in "{[\\") and _is_folder(path):
        files = _listed_by_tasks(spark, path, pattern)
    else:
        with _listed_in_runs(spark):
            files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    if stage:
        files.write.parquet(stage)
        files = spark.read.schema(files.schema).parquet(stage)
    parts = F.split("path", "/")
    n = len(depth_names)
    return files.select("*", *[F.element_at(parts, k - n).alias(name) for k, name in enumerate(depth_names)])


def _is_folder(path: str) -> bool:
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path)
    return system.get_file_info(root).type == fs.FileType.Directory


def _listed_by_tasks(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, length, modificationTime) of the files below ``path``, without those that Spark takes as hidden.

    The driver lists folders from the top until it knows four unseen ones for each core; a task for each core walks those."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path)
    root, top, n = root.rstrip("/"), _qualified(spark, path), spark.sparkContext.defaultParallelism

    def inside(system, folder: str) -> list:
        return [i for i in system.get_file_info(fs.FileSelector(folder)) if not ((i.base_name.startswith("_") and "=" not in i.base_name) or i.base_name.startswith(".") or i.base_name.endswith("._COPYING_"))]

    unseen, dealt = deque([root or "/"]), []
    while unseen and len(unseen) < 4 * n:
        folder = unseen.popleft()
        unseen += sorted(i.path for i in inside(system, folder) if i.type == fs.FileType.Directory)
        dealt.append((folder, False))
    dealt += [(folder, True) for folder in unseen]

    def walk(folders: Iterator[tuple[str, bool]]) -> Iterator[tuple]:
        system, _ = fs.FileSystem.from_uri(path)
        for folder, deep in folders:
            left = [folder]
            while left:
                for i in inside(system, left.pop()):
                    if i.type == fs.FileType.File and fnmatchcase(i.base_name, pattern):
                        yield top + i.path.removeprefix(root), i.size, i.mtime
                    elif deep and i.type == fs.FileType.Directory:
                        left.append(i.path)

    found = spark.sparkContext.parallelize([x for k in range(n) for x in dealt[k::n]], n).mapPartitions(walk)
    return spark.createDataFrame(found, "path string, length long, modificationTime timestamp", verifySchema=False)


def _qualified(spark: SparkSession, path: str) -> str:
    """``path`` as in the paths of Spark's file sources."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(top).toString().rstrip("/")


def session_inventory(files: DataFrame, root: str, volume: str = r"^images\.nii\.gz$", depth: int = 6) -> DataFrame:
    """(session, scan, input) of a tree given as an inventory with ``path``; ``root`` may name the scheme or not.

    A scan is a folder with a volume, or with slices (``.dcm``); a volume comes first. A session is a folder at most
    ``depth`` levels under ``root`` with a scan right in it; folders under a session aren't sessions. Other folders of
    files in a session have no input.
    """
    scheme = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
    base, path = f"{re.sub(scheme, '', root).rstrip('/')}/", F.regexp_replace("path", scheme, "")
    below = F.split(F.when(F.startswith(path, F.lit(base)), F.substr(path, F.lit(len(base) + 1))).otherwise(F.substring_index(path, base, -1)), "/")
    up = lambda k: F.array_join(F.slice(below, 1, F.size(below) - k), "/")
    name = F.element_at(below, -1)
    found = files.where(F.size(below) >= 2).select(up(2).alias("session"), up(1).alias("scan"), F.rlike(name, F.lit(volume)).alias("v"), F.endswith(name, F.lit(".dcm")).alias("d"))
    scans = found.groupBy("session", "scan").agg(F.bool_or("v").alias("v"), F.bool_or("d").alias("d"))
    level = F.when(F.col("session") == "", 0).otherwise(F.size(F.split("session", "/")))
    sessions = found.where("v or d").select("session").distinct().withColumn("level", level).where(F.col("level") <= depth)
    parts = F.split("session", "/")
    above = F.when(F.col("level") > 0, F.transform(F.sequence(F.lit(0), F.col("level") - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array().cast("array<string>"))
    covered = sessions.select("session", F.explode(above).alias("up")).join(sessions.select(F.col("session").alias("up")), "up", "left_semi")
    first = sessions.join(covered.select("session").distinct(), "session", "left_anti")
    return scans.join(first.select("session"), "session", "left_semi").select("session", "scan", F.when(F.col("v"), "volume").when(F.col("d"), "slices").otherwise("none").alias("input"))


def pair_images_masks(files: DataFrame, image: str = r"images\.nii\.gz$", mask: str = r"_seg\.nii(\.gz)?$", reviewed: Column | None = None) -> DataFrame:
    """(subject, session, scan, mask, image): every mask with its image or null; of several masks a reviewed one is
    preferred, then the first path."""
    from ..operators.joins import first_per_key

    stem = F.regexp_replace("file", mask, "")
    reviewed = F.col("path").contains("/review/") if reviewed is None else reviewed
    masks = files.where(F.col("file").rlike(mask)).select("subject", "session", stem.alias("scan"), F.col("path").alias("mask"), reviewed.alias("_r"))
    masks = first_per_key(masks, ["subject", "session", "scan"], [F.desc("_r"), "mask"]).drop("_r")
    images = files.where(F.col("file").rlike(image)).select("subject", "session", "scan", F.col("path").alias("image"))
    return masks.join(images, ["subject", "session", "scan"], "left")


class HeaderSource(DataSource):
    """Data source ``scan_headers``: the first bytes of the first file of each folder below ``path``, by name.

    Options: ``path``, ``bytes`` (of a header, 64 KB unless given), ``pattern`` of file names, ``depth`` of the folders
    that are dealt to tasks (1: a task for each folder right below the path). Columns: folder, n_slices, head, error. The
    driver lists ``depth`` levels only; tasks walk what is below, and open one file per folder for its first bytes."""

    @classmethod
    def name(cls) -> str:
        return "scan_headers"

    def schema(self) -> str:
        return "folder string, n_slices long, head binary, error string"

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(dict(self.options))


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.bytes = options["path"], int(options.get("bytes", 1 << 16))
        self.pattern, self.depth = options.get("pattern", "*"), int(options.get("depth", 1))

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = self._open()
        level, alone = [root], []
        for _ in range(self.depth):
            inside = [i for folder in level for i in system.get_file_info(fs.FileSelector(folder))]
            alone += level  # files right in a folder that is opened here
            level = sorted(i.path for i in inside if i.type == fs.FileType.Directory)
        return [*(InputPartition((folder, False)) for folder in alone), *(InputPartition((folder, True)) for folder in level)]

    def read(self, partition: InputPartition):
        from pyarrow import fs

        system, _ = self._open()
        (top, deep), found = partition.value, {}
        for info in system.get_file_info(fs.FileSelector(top, recursive=deep)):
            if info.type == fs.FileType.File and fnmatch(info.base_name, self.pattern):
                folder = info.path.rpartition("/")[0]
                first, n = found.get(folder, (info.path, 0))
                found[folder] = (min(first, info.path), n + 1)
        for folder, (path, n) in found.items():
            try:
                with system.open_input_stream(path) as f:
                    yield folder, n, f.read(self.bytes), None
            except OSError as e:
                yield folder, n, None, f"{type(e).__name__}: {e}"


def scan_headers(spark: SparkSession, path: str, parse: Callable[[bytes], dict], columns: list[str], pattern: str = "*", header_bytes: int = 1 << 16, depth: int = 1) -> DataFrame:
    """(folder, n_slices, columns, error) as :func:`scan_scan_headers`, for a store that tasks can open by URI: each task
    reads ``header_bytes`` of one file per folder, and the driver holds no list of folders below ``depth``."""
    spark.dataSource.register(HeaderSource)
    heads = spark.read.format("scan_headers").option("bytes", header_bytes).option("pattern", pattern).option("depth", depth).load(path)
    schema = ", ".join(["folder string", "n_slices long", *[f"`{c}` string" for c in columns], "error string"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for folder, n, head, error in zip(pdf["folder"], pdf["n_slices"], pdf["head"], pdf["error"], strict=True):
                found: dict = {}
                if head is not None:
                    try:
                        found = parse(bytes(head))
                    except Exception as e:  # noqa: BLE001  a bad file is a row, not the end of the job
                        error = f"{type(e).__name__}: {e}"
                rows.append((folder, n, *[None if found.get(c) is None else str(found[c]) for c in columns], error))
            yield pd.DataFrame(rows, columns=["folder", "n_slices", *columns, "error"])

    return heads.mapInPandas(read, schema)


def scan_scan_headers(spark: SparkSession, path: str, parse: Callable[[bytes], dict], columns: list[str], pattern: str = "*") -> DataFrame:
    """Header of the first file of each folder by a given parser, with the number of files; a file that the parser
    can't read gives a row with its error.

    Only the first file of a folder is opened: the listing doesn't read contents. Tasks open the files that they are
    dealt by URI; where they can't, the driver names the chosen paths to Spark's reader, which lists them once more.
    """
    with _listed_in_runs(spark):
        listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path")
    folders = listed.groupBy(F.regexp_replace("path", r"/[^/]+$", "").alias("folder")).agg(F.min("path").alias("path"), F.count("*").alias("n_slices"))
    schema = ", ".join(["folder string", "n_slices long", *[f"`{c}` string" for c in columns], "error string"])
    by_uri = opened_by_uri(path)
    top = _qualified(spark, path)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path) if by_uri else (None, "")
        for pdf in batches:
            rows = []
            for folder, n, file in zip(pdf["folder"], pdf["n_slices"], pdf["path" if by_uri else "content"], strict=True):
                if by_uri:
                    with system.open_input_stream(root.rstrip("/") + file.removeprefix(top), compression=None) as f:
                        file = f.read()
                try:
                    found, error = parse(bytes(file)), None
                except Exception as e:  # noqa: BLE001  a bad file is a row, not the end of the job
                    found, error = {}, f"{type(e).__name__}: {e}"
                rows.append((folder, n, *[None if found.get(c) is None else str(found[c]) for c in columns], error))
            yield pd.DataFrame(rows, columns=["folder", "n_slices", *columns, "error"])

    if by_uri:
        return folders.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "folder").mapInPandas(read, schema)
    chosen = [r.path for r in folders.persist().select("path").collect()]
    if not chosen:
        return spark.createDataFrame([], schema)
    with _listed_in_runs(spark):
        opened = spark.read.format("binaryFile").load(chosen).select("path", "content")
    return opened.join(folders, "path").select("folder", "n_slices", "content").mapInPandas(read, schema)
