"""Queries of readers and sinks over files that Spark writes from the tables, and of the remaining operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import scans as A
from ..functions import text as X
from ..operators import joins as J
from ..operators import rows as W
from ..operators import voxels as V
from ..sources import readers, sinks
from ..streaming import results
from .registry import Registry, Tables
from .reports import T, truth
from .shapes import VOX, _folder, voxels

R = Registry()
VX = "WITH vox AS (SELECT " + ", ".join(VOX) + " FROM lineitem)"


def _written(run):
    """Query that writes with ``run(t, path)`` and reads the folder back."""
    def query(t: Tables) -> DataFrame:
        path = _folder(t)
        return run(t, path) or t.spark.read.parquet(path)

    return query


R.query("SELECT n_name FROM nation", key="write_table")(_written(lambda t, p: sinks.write_table(t.nation.select("n_name"), p)))
R.query("SELECT n_nationkey, n_name FROM nation", key="write_index")(_written(lambda t, p: sinks.write_index(t.nation, p, ["n_nationkey", "n_name"])))
R.query("SELECT o_orderkey FROM orders", key="append_guarded")(_written(lambda t, p: [sinks.append_guarded(t.orders.where(f"o_orderkey % 2 = {k}").select("o_orderkey"), p) for k in (0, 1)] and None))
R.query("SELECT r_name FROM region", key="write_backup_version")(_written(lambda t, p: sinks.write_backup_version(t.region.select("r_name"), p, "1") or t.spark.read.parquet(f"{p}/current")))
R.query("SELECT 's' || s_suppkey AS scan, CASE WHEN s_suppkey % 2 = 0 THEN 'review/m' ELSE 'm' END AS mask, CASE WHEN s_suppkey % 3 = 0 THEN 'i' END AS image FROM supplier", key="pair_images_masks")(lambda t: readers.pair_images_masks(_tree(t)).select("scan", F.when(F.col("mask").contains("/review/"), "review/m").otherwise("m").alias("mask"), F.when(F.col("image").isNotNull(), "i").alias("image")))


def _tree(t: Tables) -> DataFrame:
    """Inventory rows of masks (some reviewed as well) and images."""
    s = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("scan"), "s_suppkey")
    base = lambda d, kind, file, path: d.select(F.lit("p").alias("subject"), F.lit("d").alias("session"), F.lit(kind).alias("k"), "scan", file.alias("file"), path.alias("path"))
    mask = F.concat("scan", F.lit("_seg.nii.gz"))
    every = base(s, "m", mask, F.concat(F.lit("r/segs/"), mask)).unionByName(base(s.where("s_suppkey % 2 = 0"), "m", mask, F.concat(F.lit("r/review/x/"), mask)))
    return every.unionByName(base(s.where("s_suppkey % 3 = 0"), "i", F.lit("images.nii.gz"), F.concat("scan", F.lit("/images.nii.gz")))).drop("k")


# ------------------------------------------------------------ rules and records
R.query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderkey % 20 > 1 AND o_orderkey % 4 > 1 THEN CASE WHEN o_orderkey % 9 > 4 THEN 'IVIM' WHEN o_orderkey % 20 > 16 * (o_orderkey % 4 - 1) + 1 THEN 'DTI' END END WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 20 > 10 THEN 'DCE' WHEN o_orderkey % 20 > 1 THEN 'T1W-CESC' ELSE 'T1W-CE' END ELSE 'T1W-FS' END ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'T2W-FS' ELSE 'T2W' END END AS name FROM orders", key="sequence_name")(lambda t: t.orders.select("o_orderkey", A.sequence_name(F.expr("CASE o_orderstatus WHEN 'P' THEN 'DW' WHEN 'F' THEN 'T1W' ELSE 'T2W' END"), F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 20, F.col("o_orderkey") % 4, F.col("o_orderkey") % 9).alias("name")))
R.query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'T2*' WHEN 1 THEN 'T1' WHEN 2 THEN 'DWI' WHEN 3 THEN 'PD' ELSE 'other' END AS guess FROM part", key="guess_from_name")(lambda t: t.part.select("p_partkey", A.guess_from_name(F.expr("element_at(array('x_t2*_T1', 'ax t1', 'adc', 'pdw', 'xyz'), CAST(p_partkey % 5 + 1 AS INT))")).alias("guess")))
R.query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN greatest(p_size, 800) WHEN p_partkey % 3 = 1 THEN p_size ELSE 50 END AS b FROM part", key="vendor_bvalue")(lambda t: t.part.selectExpr("p_partkey", "CASE WHEN p_partkey % 3 < 2 THEN CAST(p_size AS STRING) END AS a", r"CASE WHEN p_partkey % 3 = 0 THEN '1000800\\6\\0' END AS packed", "'dwi_b50' AS name").select("p_partkey", A.vendor_bvalue(["a"], "packed", "name").alias("b")))
R.query("SELECT vec_id, ['Sagital', 'Coronal', 'Axial'][list_position(n, list_max(n))] AS plane FROM (SELECT vec_id, [abs(e[2] * e[6] - e[3] * e[5]), abs(e[3] * e[4] - e[1] * e[6]), abs(e[1] * e[5] - e[2] * e[4])] AS n FROM (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings))", key="orientation_text")(lambda t: t.embeddings.select("vec_id", A.orientation_text(F.col("embedding").cast("array<double>"))["plane"].alias("plane")))
R.query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'a,b' END AS family FROM orders", key="sequence_family")(lambda t: t.orders.select("o_orderkey", A.sequence_family(F.expr("CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END"), F.lit("a"), F.lit("b")).alias("family")))
R.query("SELECT o_orderkey, (o_orderstatus = 'F')::INT AS k_full, (o_orderstatus = 'O')::INT AS k_O, (o_orderstatus IN ('F', 'O'))::INT AS k_any FROM orders", key="tag_feature_pipeline")(lambda t: t.orders.withColumn("s", L.map_codes("o_orderstatus", {"F": "full"})).select("o_orderkey", *L.one_hot("s", ["full", "O"], "k")).withColumn("k_any", L.or_columns("k_full", "k_O")))
R.query("SELECT o_orderkey, substr(o_orderpriority, 1, 3) AS age FROM orders", key="age_prefix")(lambda t: t.orders.select("o_orderkey", A.age_prefix("o_orderpriority").alias("age")))
R.query("SELECT c_custkey, c_mktsegment AS segment, 'Unknown' AS city, 1 AS n FROM customer", key="clinical_record")(lambda t: t.customer.select("c_custkey", A.clinical_record(["c_name", F.lit(" ")], segment="c_mktsegment", city=F.lit("none")).alias("r")).select("c_custkey", "r.segment", "r.city", F.size("r.labels").alias("n")))
R.query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '/data/batch1/' || p_brand || '/' || p_partkey END AS path FROM part", key="compose_path")(lambda t: t.part.select("p_partkey", A.compose_path("/data", F.when(F.col("p_partkey") % 2 == 0, "batch1"), "p_brand", "p_partkey").alias("path")))
R.query("SELECT p_partkey, 'e/' || p_partkey AS id FROM part", key="relative_id")(lambda t: t.part.select("p_partkey", A.relative_id(F.concat(F.lit("/root/e/"), "p_partkey", F.lit(".csv")), "/root").alias("id")))
R.query("SELECT event_id, event_type AS uid, user_id::INT AS score, value AS probability FROM events", key="result_flatten")(lambda t: t.events.select("event_id", A.result_flatten(F.to_json(F.struct(F.col("event_type").alias("uid"), F.struct(F.col("user_id").alias("score"), F.col("value").alias("probability")).alias("result")))).alias("r")).select("event_id", "r.*"))
R.query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN l_orderkey::VARCHAR ELSE l_orderkey || '/' || l_linenumber END AS id FROM lineitem", key="make_case_id")(lambda t: t.lineitem.select("l_orderkey", "l_linenumber", A.make_case_id("l_orderkey", F.when(F.col("l_linenumber") > 1, F.col("l_linenumber").cast("string"))).alias("id")))
R.query("SELECT page_id, 'scan ' || page_id AS rest FROM pages", key="strip_leading_number")(lambda t: t.pages.select("page_id", X.strip_leading_number(F.expr("concat(page_id, '_scan ', page_id)")).alias("rest")))
R.query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'F' THEN 2 ELSE 3 END, o_orderkey) = 1", key="pick_by_preference")(lambda t: J.first_per_key(t.orders, ["o_custkey"], [F.expr("nvl(nullif(array_position(array('P', 'F'), o_orderstatus), 0), 3)"), "o_orderkey"]).select("o_custkey", "o_orderkey"))
R.query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'old' ELSE event_type END AS shape FROM events", key="repair_from_reply")(lambda t: t.events.select("event_id", F.element_at(A.repair_from_reply(F.expr("CASE WHEN event_id % 2 = 0 THEN map('shape', 'old') ELSE map('shape', ' ', 'x', 'y') END"), F.expr("concat('<think>{\"shape\":\"no\"}</think>```json {\"shape\": \"', event_type, '\"} ```')"), "shape"), "shape").alias("shape")))
R.query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O')", key="vocabulary_minus")(lambda t: t.orders.where(F.col("o_orderstatus").isin(*A.vocabulary_minus(["F", "O", "P"], ["P"]))).select("o_orderkey", "o_orderstatus"))
R.query("SELECT p_partkey, round_even(12.0::DOUBLE / p_size, 0)::INT AS px FROM part", key="margin_to_px")(lambda t: t.part.select("p_partkey", V.margin_to_px(12.0, F.col("p_size").cast("double")).alias("px")))


QUERIES, ORACLE = R.queries, R.oracle
