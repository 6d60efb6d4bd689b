"""Queries of voxel and box geometry, scores and probes, sinks, streams and inference seams."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import infer as I
from ..operators import rows as W
from ..operators import scores as C
from ..operators import voxels as V
from ..sources import sinks
from ..streaming import results
from .registry import Registry, Tables

R = Registry()
#: Voxels derived from order lines.
VOX = ["l_returnflag AS case_id", "CAST(l_partkey % 20 AS INT) AS x", "CAST(l_suppkey % 16 AS INT) AS y", "CAST(l_linenumber AS INT) AS z", "l_quantity AS value", "CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END AS label"]
X = "WITH vox AS (SELECT " + ", ".join(VOX) + " FROM lineitem)"


def voxels(t: Tables) -> DataFrame:
    return t.lineitem.selectExpr(*VOX)


def points(t: Tables, keep: str) -> DataFrame:
    return voxels(t).where(keep).select("case_id", "x", "y", "z").distinct()


_BOX = "min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1"
R.query(f"{X}, b AS (SELECT case_id, min(x) AS x0, max(x) AS x1 FROM vox GROUP BY 1) SELECT case_id, greatest(0, x0 - 2) AS x0, least(19, x1 + 2) AS x1 FROM b", key="clip_box")(lambda t: V.expand_box(V.mask_box(voxels(t), ["case_id"], ("x",)), {"x": F.lit(2)}, {"x": F.lit(20)}))
R.query("SELECT p_partkey, i::DOUBLE / (200 - i) AS iou FROM (SELECT p_partkey, greatest(0, 10 - p_size) * 10 AS i FROM part)", key="box_iou")(lambda t: t.part.select("p_partkey", V.box_iou([F.lit(0), F.lit(9), F.lit(0), F.lit(9)], [F.col("p_size"), F.col("p_size") + 9, F.lit(0), F.lit(9)]).alias("iou")))
R.query(f"{X} SELECT case_id, z AS slice, count(*) AS area FROM vox GROUP BY ALL", key="slice_areas")(lambda t: V.slice_areas(voxels(t), ["case_id"], "z"))
R.query(f"{X}, a AS (SELECT case_id, z AS slice, count(*) AS area FROM vox GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY area DESC, slice DESC)::INT AS rank FROM a QUALIFY rank <= 3", key="topk_slices")(lambda t: V.topk_slices(V.slice_areas(voxels(t), ["case_id"], "z"), ["case_id"], 3))
R.query(f"{X} SELECT case_id, unnest(range(a, b + 1))::INT AS slice FROM (SELECT case_id, min(z) AS a, max(z) AS b FROM vox GROUP BY 1)", key="slice_span")(lambda t: V.slice_span(voxels(t), ["case_id"], "z"))
R.query(f"{X} SELECT case_id, arg_max(slice, (area, slice)) AS slice FROM (SELECT case_id, z AS slice, count(*) AS area FROM vox GROUP BY ALL) GROUP BY 1", key="largest_area_slice")(lambda t: V.topk_slices(V.slice_areas(voxels(t), ["case_id"], "z"), ["case_id"], 1).select("case_id", "slice"))
_TWO = "a AS (SELECT DISTINCT case_id, x, y, z FROM vox WHERE value > 25), b AS (SELECT DISTINCT case_id, x, y, z FROM vox WHERE value < 35)"
R.query(f"{X}, {_TWO}, j AS (SELECT coalesce(a.case_id, b.case_id) AS case_id, count(a.x) AS n_a, count(b.x) AS n_b, count_if(a.x IS NOT NULL AND b.x IS NOT NULL) AS i FROM a FULL JOIN b ON a.case_id = b.case_id AND a.x = b.x AND a.y = b.y AND a.z = b.z GROUP BY 1) SELECT case_id, n_a, n_b, 2.0::DOUBLE * i / (n_a + n_b) AS dice, i::DOUBLE / (n_a + n_b - i) AS iou FROM j", key="dice_iou")(lambda t: V.dice_iou(points(t, "value > 25"), points(t, "value < 35"), ["case_id"], ["x", "y", "z"]))
R.query(f"{X}, m AS (SELECT DISTINCT case_id, x, y, z FROM vox WHERE label = 1) SELECT case_id, count(*) AS n, sum(CASE WHEN m.x IS NOT NULL THEN value ELSE 0 END) AS inside FROM vox LEFT JOIN m USING (case_id, x, y, z) GROUP BY 1", key="mask_filter")(lambda t: V.mask_filter(voxels(t), voxels(t).where("label = 1"), ["case_id"], ["x", "y", "z"], "value").groupBy("case_id").agg(F.count("*").alias("n"), F.sum("value").alias("inside")))
R.query(f"{X}, q AS (SELECT case_id, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM vox WHERE value <> 0 GROUP BY 1) SELECT case_id, avg((least(greatest(value, lo), hi) - lo) / (hi - lo)) AS mean FROM vox JOIN q USING (case_id) GROUP BY 1", key="normalize_intensity")(lambda t: V.normalize_intensity(voxels(t), ["case_id"], "value").groupBy("case_id").agg(F.avg("scaled").alias("mean")))
R.query(f"{X} SELECT case_id, count(*) AS n, min(value) AS min, max(value) AS max, avg(value) AS mean, quantile_cont(value, 0.99) AS p99, count_if(label = 1) AS n_fg, avg(value) FILTER (label = 1) AS fg_mean, stddev_pop(value) FILTER (label = 1) AS fg_std FROM vox GROUP BY 1", key="volume_stats")(lambda t: V.volume_stats(voxels(t), ["case_id"], "value", F.col("label") == 1))
_HARM = ", ".join(f"({k})" for k in (1, 2, 3, 7))
R.query(f"SELECT vec_id, k, 2.0::DOUBLE / 64 * sqrt(pow(sum(v * cos(k * i * {2 * math.pi / 64}::DOUBLE)), 2) + pow(sum(v * sin(k * i * {2 * math.pi / 64}::DOUBLE)), 2)) AS amplitude FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), (VALUES {_HARM}) h(k) GROUP BY ALL", key="harmonic_amplitudes")(lambda t: V.harmonic_amplitudes(t.embeddings.select("vec_id", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double")), ["vec_id"], "i", "v", 64, [1, 2, 3, 7]))
R.query(f"SELECT p_partkey, {4 * math.pi}::DOUBLE * p_size / (p_retailprice * p_retailprice) AS c FROM part", key="circularity")(lambda t: t.part.select("p_partkey", V.circularity(F.col("p_size"), F.col("p_retailprice")).alias("c")))
R.query("SELECT vec_id, sqrt(e[1] * e[1] + e[4] * e[4] + e[7] * e[7]) AS sx, sqrt(e[2] * e[2] + e[5] * e[5] + e[8] * e[8]) AS sy FROM (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings)", key="voxel_spacing")(lambda t: t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e")).select("vec_id", V.voxel_spacing("e")[0].alias("sx"), V.voxel_spacing("e")[1].alias("sy")))
R.query("SELECT vec_id, ['sagittal', 'coronal', 'axial'][list_position(embedding[:3], list_max(embedding[:3]))] AS plane FROM embeddings", key="plane_from_affine")(lambda t: t.embeddings.select("vec_id", V.plane_of(F.slice("embedding", 1, 3)).alias("plane")))
R.query(f"{X}, s AS (SELECT case_id, avg(value) FILTER (label = 1) AS m, stddev_pop(value) FILTER (label = 1) AS d FROM vox GROUP BY 1) SELECT case_id, max((value - m) / d) AS hi FROM vox JOIN s USING (case_id) GROUP BY 1", key="normalize_masked")(lambda t: voxels(t).join(V.volume_stats(voxels(t), ["case_id"], "value", F.col("label") == 1).select("case_id", "fg_mean", "fg_std"), "case_id").groupBy("case_id").agg(F.max((F.col("value") - F.col("fg_mean")) / F.col("fg_std")).alias("hi")))

# ------------------------------------------------------------ scores
_LONG = "long AS (SELECT vec_id, i::VARCHAR AS c, embedding[i + 1]::DOUBLE AS s FROM embeddings, (VALUES (0), (1), (2)) v(i)), sm AS (SELECT *, exp(s - max(s) OVER (PARTITION BY vec_id)) AS e FROM long), p AS (SELECT vec_id, c, s, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM sm)"


def long_scores(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.posexplode(F.slice("embedding", 1, 3)).alias("i", "s")).select("vec_id", F.col("i").cast("string").alias("c"), F.col("s").cast("double").alias("s"))


R.query(f"WITH {_LONG} SELECT vec_id, c, s, p FROM p", key="softmax_rows")(lambda t: C.softmax_rows(long_scores(t), "vec_id", "s"))
R.query("SELECT vec_id, CASE WHEN embedding[1] >= embedding[2] AND embedding[1] >= embedding[3] THEN 'a' WHEN embedding[2] >= embedding[3] THEN 'b' ELSE 'c' END AS label FROM embeddings", key="argmax_label")(lambda t: t.embeddings.select("vec_id", *[F.get("embedding", F.lit(k)).alias(n) for k, n in enumerate("abc")]).select("vec_id", C.argmax_label(list("abc"), list("abc")).alias("label")))
R.query(f"WITH {_LONG}, m AS (SELECT c, avg(p) AS m FROM p GROUP BY 1) SELECT vec_id, c, s, s - ln(m + 1e-12) AS corrected FROM p JOIN m USING (c)", key="prior_correction")(lambda t: C.prior_correction(long_scores(t), "vec_id", "c", "s").select("vec_id", "c", "s", "corrected"))


def _sep(c: str) -> str:
    from .reports import auc_sql

    return f"SELECT '{c}' AS feature, (SELECT avg({c}) FROM lineitem WHERE l_returnflag = 'R') AS mean_pos, (SELECT avg({c}) FROM lineitem WHERE l_returnflag <> 'R') AS mean_neg, auc FROM {auc_sql('lineitem', chr(108) + '_returnflag = ' + chr(39) + 'R' + chr(39), c)}"


R.query(" UNION ALL ".join(map(_sep, ("l_quantity", "l_tax"))), key="separability_table")(lambda t: C.separability_table(t.lineitem, F.col("l_returnflag") == "R", ["l_quantity", "l_tax"]))

# ------------------------------------------------------------ sinks, streams, seams


def _folder(t: Tables) -> str:
    """A fresh folder that driver and executors share."""
    base = t.spark.conf.get("spark.checkpoint.dir", None) or t.spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not t.spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{(base or tempfile.gettempdir()).rstrip('/')}/caseflow-{uuid.uuid4().hex}"
    _FOLDERS.append((t.spark, path))
    return path


def release_folders() -> None:
    """Delete the folders that this process's queries wrote."""
    while _FOLDERS:
        spark, path = _FOLDERS.pop()
        try:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # noqa: BLE001  the session may already be gone
            continue


_FOLDERS: list[tuple] = []
atexit.register(release_folders)


@R.query("SELECT o_orderkey, o_orderstatus FROM orders")
def append_resumable(t):
    path = _folder(t)
    rows = t.orders.select("o_orderkey", "o_orderstatus")
    sinks.append_resumable(rows.where("o_orderkey % 3 = 0"), path, ["o_orderkey"])
    sinks.append_resumable(rows, path, ["o_orderkey"])
    return t.spark.read.parquet(path)


@R.query("SELECT o_orderkey, o_orderstatus || 'x' AS o_orderstatus FROM orders")
def write_in_place(t):
    path = _folder(t)
    sinks.write_table(t.orders.select("o_orderkey", "o_orderstatus"), path)
    sinks.write_in_place(t.spark.read.parquet(path).withColumn("o_orderstatus", F.concat("o_orderstatus", F.lit("x"))), path)
    return t.spark.read.parquet(path)


@R.query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(*) AS combined FROM orders GROUP BY ALL")
def write_per_entity(t):
    """A folder of documents per status and priority, and the combined document, whose records are counted by key."""
    path, whole = _folder(t), _folder(t)
    rows = t.orders.select("o_orderkey", F.concat_ws("_", "o_orderstatus", "o_orderpriority").alias("entity"))
    sinks.write_per_entity(rows, path, "entity")
    sinks.write_combined(rows, whole, "entity")
    n = t.spark.read.json(path).groupBy("entity").agg(F.count("*").alias("n"))
    combined = t.spark.read.json(whole).select("entity", F.size("records").cast("long").alias("combined"))
    return n.join(combined, "entity").select(F.substring_index("entity", "_", 1).alias("o_orderstatus"), F.substring_index("entity", "_", -1).alias("o_orderpriority"), "n", "combined")


@R.query("SELECT event_id, user_id, event_type FROM events")
def stream_results_append(t):
    """Days come file by file, each with the day before once more; a restart reads the last file again under another name."""
    path, check, folder = _folder(t), _folder(t), _folder(t)
    rows = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    edges = rows.agg(F.min("ts"), F.max("ts")).first()
    step = (edges[1] - edges[0]) / 4
    for k in (0, 1, 2, 3, 3):
        part = rows.where((F.col("ts") >= F.lit(edges[0] + (k - 1) * step)) & ((F.col("ts") < F.lit(edges[0] + (k + 1) * step)) | F.lit(k == 3)))
        part.coalesce(1).write.mode("append").parquet(folder)
        source = results.read_results(t.spark, folder, rows.schema, files=1)
        results.stream_results_append(source, path, check, ["event_id"], "ts", f"{int(step.total_seconds() * 2) + 1} seconds").awaitTermination()
    return t.spark.read.parquet(path).select("event_id", "user_id", "event_type")


R.query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus || '!' END AS raw_output, CASE WHEN o_orderkey % 5 = 0 THEN 'ValueError: bad' END AS error FROM orders", key="batch_infer")(lambda t: I.batch_infer(t.orders.select("o_orderkey", "o_orderstatus"), _shout, "o_orderkey"))
R.query("SELECT o_orderkey, 'ValueError: bad' AS error FROM orders WHERE o_orderkey % 5 = 0", key="error_rows")(lambda t: I.batch_infer(t.orders.select("o_orderkey", "o_orderstatus"), _shout, "o_orderkey").where("error is not null").select("o_orderkey", "error"))
R.query("SELECT o_orderkey, o_orderstatus AS one, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_totalprice > 150000 THEN 'Y' ELSE 'N' END ELSE '-' END AS two FROM orders", key="cascade_classify")(lambda t: I.cascade_classify(t.orders, [("one", F.lit(True), F.col("o_orderstatus")), ("two", F.col("one") == "F", F.when(F.col("o_totalprice") > 150000, "Y").otherwise("N"))]).select("o_orderkey", "one", "two"))


def _shout(rows: list[dict]) -> list[str]:
    if any(r["o_orderkey"] % 5 == 0 for r in rows):
        raise ValueError("bad")
    return [r["o_orderstatus"] + "!" for r in rows]


QUERIES, ORACLE = R.queries, R.oracle
