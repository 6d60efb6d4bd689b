"""Queries of review states, documents, cohorts, evaluation reports, geometry and probes."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import reply as P
from ..functions import scans as A
from ..operators import infer as I
from ..operators import joins as J
from ..operators import metrics as K
from ..operators import rows as W
from ..operators import scores as C
from ..operators import voxels as V
from . import labels, shapes
from .registry import Registry, Tables
from .reports import T, truth
from .tables import S, status

R = Registry()
VX = "WITH vox AS (SELECT " + ", ".join(shapes.VOX) + " FROM lineitem)"
#: Predictions and truths of events, some failed, some unknown; the same expressions serve Spark and DuckDB.
ANSWERS = [
    "event_id", "user_id", "value",
    "CASE event_id % 11 WHEN 0 THEN 'unknown' WHEN 1 THEN '' ELSE event_type END AS truth",
    "CASE event_id % 7 WHEN 0 THEN 'PARSE_FAILED' WHEN 1 THEN 'ERROR' WHEN 2 THEN 'click' ELSE event_type END AS pred",
    "CASE WHEN event_id % 5 = 0 THEN ' x ' WHEN event_id % 5 = 1 THEN 'X' WHEN event_id % 5 = 2 THEN 'xx' END AS mark",
    "CASE WHEN event_id % 4 = 0 THEN ' ' ELSE event_type END AS facet",
    "CAST(event_id % 5 AS STRING) AS images",
]
_A = "WITH answers AS (SELECT " + ", ".join(ANSWERS) + " FROM events)"


def answers(t: Tables) -> DataFrame:
    return t.events.selectExpr(*ANSWERS)


# ------------------------------------------------------------ filters


@R.query(f"{_A} SELECT event_id FROM answers WHERE upper(trim(mark)) = 'X'")
def filter_reviewed(t):
    return W.filter_reviewed(answers(t), "mark").select("event_id")


@R.query(f"{_A} SELECT event_id, truth, pred FROM answers WHERE truth NOT IN ('', 'unknown') AND pred NOT IN ('PARSE_FAILED', 'ERROR')")
def filter_scorable(t):
    return W.filter_scorable(answers(t), "truth", "pred").select("event_id", "truth", "pred")


@R.query(f"{S} SELECT o_orderkey FROM status WHERE a IN ('F', 'P') AND b IN ('F')")
def cascade_gate(t):
    return W.cascade_gate(status(t), "a", ["F", "P"], "b", ["F"]).select("o_orderkey")


_TRI = "SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN '{blank}' WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'Yes' ELSE 'No' END AS {name} FROM customer"


@R.query(f"SELECT a.c_custkey, flag, strict FROM ({_TRI.format(blank='', name='flag')}) a JOIN ({_TRI.format(blank='Yes', name='strict')}) b USING (c_custkey)")
def tri_state_flag(t):
    """Both variants: a row without an id is blank, or counts as Yes."""
    rows = t.customer.selectExpr("c_custkey", "CASE WHEN c_custkey % 9 > 0 THEN c_custkey END AS id")
    members = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return W.tri_state_flag(W.tri_state_flag(rows, "id", members), "id", members, "strict", "Yes").drop("id")


_TAB = {"all": "true", "correct": "pred <> 'PARSE_FAILED' AND pred = truth", "wrong": "pred <> 'PARSE_FAILED' AND pred <> truth", "unparsed": "pred = 'PARSE_FAILED'"}


@R.query(_A + " " + " UNION ALL ".join(f"(SELECT '{k}' AS tab, event_id FROM answers WHERE {v} AND coalesce(nullif(trim(facet), ''), '?') = '{f}' ORDER BY value, event_id LIMIT 25 OFFSET 25)" for k, v in _TAB.items() for f in ("?", "view")))
def facet_filter_page(t):
    """The second page of every tab, of blank facets and of one that isn't."""
    pages = [W.facet_filter_page(answers(t), "truth", "pred", tab, {"facet": f}, ["value", "event_id"], 1, 25).select(F.lit(tab).alias("tab"), "event_id") for tab in _TAB for f in ("?", "view")]
    out = pages[0]
    for p in pages[1:]:
        out = out.unionByName(p)
    return out


@R.query(f"""{S}, v AS (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 'X' END AS viewed, CASE WHEN o_orderkey % 4 = 0 THEN 'To_review' ELSE a END AS final FROM status)
SELECT 'pending' AS mode, o_orderkey FROM v WHERE a = 'O' AND b = 'O' AND viewed IS NULL UNION ALL SELECT 'any', o_orderkey FROM v WHERE a = 'F'
UNION ALL SELECT 'second', o_orderkey FROM v WHERE viewed = 'X' AND final = 'To_review'""")
def pending_filter(t):
    rows = status(t).withColumns({"viewed": F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'X' END"), "final": F.expr("CASE WHEN o_orderkey % 4 = 0 THEN 'To_review' ELSE a END")})
    first = W.pending_filter(rows, {"a": "O", "b": "O"}, "viewed").select(F.lit("pending").alias("mode"), "o_orderkey")
    every = W.pending_filter(rows, {"a": "F", "b": "-"}, "viewed", pending=False).select(F.lit("any").alias("mode"), "o_orderkey")
    return first.unionByName(every).unionByName(W.pending_filter(rows, {}, "viewed", second_review=True, final={"final": "To_review"}).select(F.lit("second").alias("mode"), "o_orderkey"))


@R.query("SELECT p_partkey FROM part WHERE NOT contains(lower(p_type), 'tin') AND NOT contains(lower(p_name), 'ring')")
def skip_named_scans(t):
    return W.skip_named_scans(W.skip_named_scans(t.part, "p_type", ["Tin", "a.c"]), "p_name", ["RING"]).select("p_partkey")


@R.query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END, 'Unknown') AS segment, 'none' AS city FROM customer")
def value_or_default(t):
    rows = t.customer.selectExpr("c_custkey", "CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS segment")
    return W.value_or_default(W.value_or_default(rows, "segment", "Unknown"), "city", "none")


@R.query("""WITH v AS (SELECT * FROM (VALUES (0, 'P'), (1, 'X'), (2, 'O'), (3, 'F')) v(k, label) WHERE label IN (SELECT o_orderstatus FROM orders))
SELECT (row_number() OVER (ORDER BY k) - 1)::INT AS place, label, 1.0::DOUBLE / count(*) OVER () AS chance FROM v""")
def active_labels(t):
    """The vocabulary that holds the labels is found from them."""
    return W.active_labels(t.orders, "o_orderstatus", {"flags": ["A", "N", "R"], "states": ["P", "X", "O", "F"]})


# ------------------------------------------------------------ joins


@R.query(f"{S}, m AS (SELECT (SELECT count(*) FROM orders) AS n_a, (SELECT count(*) FROM lineitem WHERE l_linenumber = 1) AS n_b, (SELECT count(*) FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_linenumber = 1) AS matched) SELECT n_a, n_b, matched FROM m")
def join_methods_inner(t):
    """The number of matches beside the sizes; the rows themselves are in ``join_two_runs``."""
    other = t.lineitem.where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), "l_linestatus")
    return J.matched_counts(t.orders, other, ["o_orderkey"])


@R.query("SELECT o_orderkey, c_mktsegment AS segment, '' AS phone FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON o_custkey = c_custkey")
def join_left_reference(t):
    """Of the keys the reference has one, under another name, and of the columns all but one."""
    rows = t.orders.selectExpr("o_orderkey", "o_custkey AS subject", "o_orderstatus AS session", "'old' AS segment")
    reference = t.customer.where("c_custkey % 2 = 0").selectExpr("c_custkey AS id", "c_mktsegment AS segment", "c_name")
    return J.join_left_reference(rows, reference, ["subject", "session", "scan"], ["segment", "phone"], {"id": "subject"}).drop("subject", "session")


@R.query("""WITH p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN p_type END AS table_plane, [p_size::DOUBLE, (p_partkey % 30)::DOUBLE, 25.0] AS s FROM part WHERE p_partkey % 5 > 0)
SELECT o.p_partkey, coalesce(CASE WHEN table_plane <> 'unknown' THEN table_plane END, CASE WHEN o.p_partkey % 2 = 0 THEN ['sagittal', 'coronal', 'axial'][list_position([o.p_size::DOUBLE, (o.p_partkey % 30)::DOUBLE, 25.0], list_max([o.p_size::DOUBLE, (o.p_partkey % 30)::DOUBLE, 25.0]))] END, 'unknown') AS plane
FROM part o LEFT JOIN p USING (p_partkey)""")
def plane_fallback(t):
    """Half of the parts have spacings to compute a plane from."""
    table = t.part.where("p_partkey % 5 > 0").selectExpr("p_partkey", "CASE p_partkey % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN concat(p_type, ' ') ELSE '' END AS plane")
    spacing = F.when(F.col("p_partkey") % 2 == 0, F.array(F.col("p_size").cast("double"), (F.col("p_partkey") % 30).cast("double"), F.lit(25.0)))
    return J.plane_fallback(t.part.select("p_partkey", "p_size"), table, ["p_partkey"], "plane", V.plane_of(spacing)).select("p_partkey", "plane")


@R.query("SELECT o_custkey || '/' || o_orderkey AS case_id, c_mktsegment, c_nationkey FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 > 0) ON c_custkey = o_custkey")
def merge_clinical_fields(t):
    rows = t.orders.select(F.concat_ws("/", "o_custkey", "o_orderkey").alias("case_id"))
    return J.merge_clinical_fields(rows, t.customer.where("c_custkey % 3 > 0"), "case_id", "c_custkey", ["c_mktsegment", "c_nationkey"])


@R.query("""SELECT c_custkey, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS label, CASE WHEN c_custkey % 2 = 0 THEN '/abs/' || c_custkey ELSE '/base/' || c_custkey END AS path FROM customer""")
def exemplar_validate(t):
    """Labels in the options' spelling, paths made absolute; labels outside and absent paths raise (see the tests)."""
    rows = t.customer.selectExpr("c_custkey", "concat(' ', c_mktsegment) AS label", "CASE WHEN c_custkey % 2 = 0 THEN concat('/abs/', c_custkey) ELSE CAST(c_custkey AS STRING) END AS path")
    return J.exemplar_validate(rows, ["Automobile", "Building", "Furniture", "Household", "Machinery"], base="/base/")


# ------------------------------------------------------------ documents and cohorts


@R.query("""WITH v AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'subject' ELSE 'image' END AS level FROM events)
SELECT CASE level WHEN 'subject' THEN 'subject ["' || user_id || '","' || event_type || '"]' ELSE 'image ["' || event_id // 4 || '"]' END AS target, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM v GROUP BY 1""")
def latest_verdict(t):
    """A subject's verdict is one per feature, an image's one per image."""
    rows = t.events.select("event_id", "ts", "user_id", "event_type", F.expr("event_id DIV 4").alias("image"), F.expr("CASE WHEN event_id % 3 = 0 THEN 'subject' ELSE 'image' END").alias("level"))
    return W.latest_verdict(rows, "level", {"subject": ["user_id", "event_type"], "image": ["image"]}, ["ts", "event_id"]).select("target", "ts", "event_id")


@R.query("""WITH d AS (SELECT o_custkey AS s, 'd/' || o_orderkey AS path, o_orderstatus = 'P' AS rev FROM orders WHERE o_orderkey % 4 = 0),
g AS (SELECT s, count(*) AS n, count_if(rev) AS r, min(path) AS anyp, min(path) FILTER (rev) AS own FROM d GROUP BY 1),
j AS (SELECT c_custkey AS s, c_custkey % 8 > 0 AS k, CASE WHEN k THEN coalesce(n, 0) ELSE 0 END AS n, CASE WHEN k THEN coalesce(r, 0) ELSE 0 END AS r, anyp, own FROM customer LEFT JOIN g ON s = c_custkey)
SELECT s AS c_custkey, CASE WHEN NOT k THEN 'subject_not_found' WHEN n = 0 THEN 'no_json' WHEN n = 1 THEN 'ok_single' WHEN r = 1 THEN 'ok_reviewed' ELSE 'ok_ambiguous' END AS status,
CASE WHEN k THEN CASE WHEN n > 1 AND r > 0 THEN own ELSE anyp END END AS chosen, n AS n_documents, r AS n_reviewed,
CASE WHEN NOT k THEN 'no folder' WHEN n = 0 THEN 'no document in any review' WHEN n = 1 THEN '' WHEN r = 1 THEN n || ' documents, the reviewed one taken' WHEN r > 1 THEN r || ' reviewed documents, the first by path taken' ELSE n || ' documents, none reviewed, the first by path taken' END AS note FROM j""")
def select_document(t):
    docs = t.orders.where("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("c_custkey"), F.concat(F.lit("d/"), "o_orderkey").alias("path"), (F.col("o_orderstatus") == "P").alias("reviewed"))
    return W.select_document(t.customer, t.customer.where("c_custkey % 8 > 0"), docs, "c_custkey", "path", "reviewed")


@R.query("""SELECT c_custkey, j AS has_json, s AS has_seg, j::INT + s::INT AS priority FROM (SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS j, c_acctbal > 0 AS s FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_mktsegment <> 'BUILDING')""")
def cohort_pool(t):
    c, o = t.customer.select("c_custkey"), t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return W.cohort_pool(c, o, t.customer.where("c_mktsegment = 'BUILDING'"), "c_custkey", {"json": o.where("o_orderstatus = 'P'"), "seg": t.customer.where("c_acctbal > 0")})


@R.query("""WITH d AS (SELECT l_orderkey AS k, l_shipdate::DATE::VARCHAR || l_returnflag AS f, min(l_linenumber * 100000 + l_suppkey) AS at FROM lineitem GROUP BY 1, 2)
SELECT a.k, a.f, coalesce(string_agg(b.f, ';' ORDER BY b.at, b.f) FILTER (b.f <> a.f), '') AS others FROM d a JOIN d b ON a.k = b.k GROUP BY 1, 2""")
def sibling_values(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("k"), F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), "l_returnflag").alias("f"), (F.col("l_linenumber") * 100000 + F.col("l_suppkey")).alias("at"))
    return W.sibling_values(rows, ["k"], "f", "at").select("k", "f", F.array_join("others", ";").alias("others"))


# ------------------------------------------------------------ reports


@R.query(f"""{_A}, k AS (SELECT *, CASE images WHEN '1' THEN '1' WHEN '2' THEN '2' WHEN '0' THEN '0' ELSE '3-4' END AS bucket FROM answers WHERE truth NOT IN ('', 'unknown'))
SELECT CASE grouping(truth, bucket) WHEN 3 THEN 'overall' WHEN 1 THEN 'feature' ELSE 'images' END AS section, coalesce(truth, bucket, '') AS value, count(*) AS n, avg((truth = pred)::INT::DOUBLE) AS accuracy, count_if(pred = 'PARSE_FAILED') AS parse_failures
FROM k GROUP BY GROUPING SETS ((), (truth), (bucket))""".replace("(truth = pred)::INT", "ok").replace("AS bucket FROM", "AS bucket, (truth = pred)::INT AS ok FROM"))
def accuracy_report(t):
    return K.accuracy_report(answers(t), "truth", "pred", "truth", "images")


_ROLL = ["click", "error", "view"]


@R.query(f"""{_A}, k AS (SELECT user_id % 20 AS e, truth, pred, pred <> 'PARSE_FAILED' AS parsed FROM answers),
c AS (SELECT e, truth, count_if(parsed) AS s, count_if(parsed AND pred = truth) AS ok, count(*) AS n FROM k GROUP BY 1, 2),
p AS (SELECT e, pred, count(*) AS n FROM k WHERE parsed GROUP BY 1, 2), t AS (SELECT e, arg_min(pred, (-n, pred)) AS top_pred, max(n)::DOUBLE / sum(n) AS top_pred_frac FROM p GROUP BY 1)
SELECT e, sum(s)::BIGINT AS n, sum(c.n - s)::BIGINT AS n_unparsed, count_if(s > 0) AS n_classes, 1.0::DOUBLE / nullif(count_if(s > 0), 0) AS chance, sum(ok)::DOUBLE / sum(s) AS accuracy, avg(ok::DOUBLE / nullif(s, 0)) AS macro_acc,
{', '.join(f"max(CASE WHEN truth = '{c}' THEN ok::DOUBLE / nullif(s, 0) END) AS acc_{c}" for c in _ROLL)}, any_value(top_pred) AS top_pred, any_value(top_pred_frac) AS top_pred_frac FROM c LEFT JOIN t USING (e) GROUP BY 1""")
def experiment_rollup(t):
    return K.experiment_rollup(answers(t).withColumn("e", F.col("user_id") % 20), "e", "truth", "pred", _ROLL)


#: Segmentation results derived from order lines.
SEG = [
    "concat('b', CAST(l_suppkey % 4 AS STRING)) AS backend", "l_discount * 10 AS dice", "l_tax * 10 AS iou", "l_quantity AS hd95", "CASE WHEN l_suppkey % 4 = 0 THEN l_linenumber % 2 ELSE 1 END AS jitter",
    "l_quantity / 50 AS gt_circularity", "l_quantity / 50 + CASE WHEN l_suppkey % 2 = 0 THEN 0.1 ELSE -0.01 END AS pred_circularity", "l_tax AS gt_jag", "l_tax - CASE WHEN l_suppkey % 4 = 3 THEN 0.05 ELSE 0 END AS pred_jag", "l_linenumber % 3 AS parts",
]
_SEG = "WITH seg AS (SELECT " + ", ".join(SEG) + " FROM lineitem)"


@R.query(f"""{_SEG} SELECT backend, count(*) AS n, avg(dice) AS dice, avg(iou) AS iou, avg(hd95) AS hd95, round(avg(pred_circularity) - avg(gt_circularity), 9) AS delta_circularity, round(avg(pred_jag) - avg(gt_jag), 9) AS delta_jag,
avg((parts > 1)::INT::DOUBLE) AS fragmented, count(DISTINCT jitter) > 1 AS mixed, median(dice) AS dice_median, quantile_cont(dice, 0.1) AS dice_p10,
avg(pred_circularity) - avg(gt_circularity) > 0.05::DOUBLE OR avg(pred_jag) - avg(gt_jag) < -0.02::DOUBLE AS smoothing FROM seg GROUP BY 1""")
def backend_compare(t):
    g = K.backend_compare(t.lineitem.selectExpr(*SEG), "backend", ["jitter"], ["circularity", "jag"], "parts", ("circularity", 0.05), ("jag", -0.02))
    return g.withColumns({c: F.round(c, 9) for c in ("delta_circularity", "delta_jag")})


@R.query("""WITH need AS (SELECT * FROM (VALUES ('f1', 1), ('f1', 2), ('f2', 5), ('f3', 3), ('f3', 9)) v(feature, l)), c AS (SELECT DISTINCT l_orderkey AS c FROM lineitem),
p AS (SELECT feature, c, count(*) AS n, count(v) AS k FROM c, need LEFT JOIN (SELECT l_orderkey, l_linenumber, min(l_partkey) AS v FROM lineitem GROUP BY 1, 2) ON l_orderkey = c AND l_linenumber = l GROUP BY 1, 2)
SELECT feature, count(*) AS cases, count_if(k = n) AS met_all, count_if(k > 0 AND k < n) AS met_some, count_if(k = 0) AS met_none FROM p GROUP BY 1""")
def coverage_report(t):
    needs = t.spark.createDataFrame([("f1", 1), ("f1", 2), ("f2", 5), ("f3", 3), ("f3", 9)], "feature string, l int")
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("c"), F.col("l_linenumber").alias("l")).agg(F.min("l_partkey").alias("v"))
    have = lines.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in ("f1", "f2", "f3")])))
    return K.coverage_report(J.resolve_requirements(t.lineitem.select(F.col("l_orderkey").alias("c")), needs, have, "c", ["feature", "l"], "v"), "feature", "c", "v")


@R.query("""WITH v AS (SELECT event_type AS feature, CASE event_id % 5 WHEN 0 THEN ['a' || user_id % 4, 'b'] WHEN 1 THEN [' '] ELSE ['s' || user_id % 3] END AS vs, event_id % 5 = 0 AND event_type < 'm' AS l, event_id FROM events WHERE event_id % 5 > 0 OR event_type < 'm')
SELECT feature, string_agg(DISTINCT x, ';' ORDER BY x) FILTER (x <> '') AS options, bool_or(l) AS multi_select FROM (SELECT feature, trim(unnest(vs)) AS x, l FROM v) GROUP BY 1""")
def label_vocabulary(t):
    """Some features hold lists, some scalars, some blanks."""
    rows = t.events.where("event_id % 5 > 0 OR event_type < 'm'").selectExpr("event_type AS feature", "CASE event_id % 5 WHEN 0 THEN to_json(array(concat('a', user_id % 4), 'b')) WHEN 1 THEN ' ' ELSE concat('s', user_id % 3) END AS v")
    return K.label_vocabulary(rows, "feature", "v").withColumn("options", F.array_join("options", ";"))


@R.query("""WITH r AS (SELECT CASE p_brand WHEN 'Brand#1' THEN 'Localizer' ELSE p_brand END AS b, p_name, p_type FROM part), u AS (SELECT * FROM r WHERE b <> 'Localizer'),
top AS (SELECT b, count(DISTINCT p_name) AS subjects FROM u GROUP BY 1 ORDER BY subjects DESC, b LIMIT 6)
SELECT b, any_value(subjects) AS subjects, count(DISTINCT CASE WHEN p_type = 'ECONOMY' THEN p_name END) AS "ECONOMY", count(DISTINCT CASE WHEN p_type = 'PROMO' THEN p_name END) AS "PROMO" FROM u JOIN top USING (b) GROUP BY 1""")
def top_modalities_by_facet(t):
    rows = t.part.withColumn("b", F.expr("CASE p_brand WHEN 'Brand#1' THEN 'Localizer' ELSE p_brand END"))
    return K.top_labels_by_facet(rows, "b", "p_name", "p_type", ["ECONOMY", "PROMO"])


@R.query("SELECT coalesce(trim(CASE WHEN o_orderkey % 9 > 0 THEN o_orderpriority END), '') AS value, count_if(ok) AS kept, count_if(NOT ok) AS excluded FROM (SELECT *, coalesce(CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice > 150000 END, false) AS ok FROM orders) GROUP BY 1")
def kept_excluded_counts(t):
    rows = t.orders.withColumn("p", F.expr("CASE WHEN o_orderkey % 9 > 0 THEN concat(o_orderpriority, ' ') END"))
    return K.kept_excluded_counts(rows, "p", F.when(F.col("o_orderkey") % 4 > 0, F.col("o_totalprice") > 150000))


_RANGES = "SELECT p_partkey % 3 AS c, p_size::DOUBLE AS p2p, (p_size + 60 * (p_partkey % 3))::DOUBLE AS area, (p_retailprice - 700 * (p_partkey % 3 = 1)::INT)::DOUBLE AS aspect FROM part"


@R.query(f"""WITH r AS (SELECT 'c' || c AS c, unnest([{{'d': 'p2p', 'v': p2p}}, {{'d': 'area', 'v': area}}, {{'d': 'kurt', 'v': area}}, {{'d': 'aspect', 'v': aspect}}]) AS x FROM ({_RANGES})),
g AS (SELECT x.d AS d, c, min(x.v) AS lo, max(x.v) AS hi FROM r GROUP BY 1, 2), m AS (SELECT d, max(greatest(abs(lo), abs(hi))) * 1e-6 AS tol FROM g GROUP BY 1),
e AS (SELECT a.d AS descriptor, a.c AS a, b.c AS b, a.hi < b.lo - tol OR b.hi < a.lo - tol AS disjoint FROM g a JOIN g b ON a.d = b.d AND a.c < b.c JOIN m ON m.d = a.d)
SELECT *, disjoint AND NOT (descriptor = 'kurt' OR (descriptor = 'area' AND a = 'c0' AND b = 'c2')) AS shortcut FROM e""")
def range_overlap_check(t):
    rows = t.part.selectExpr("concat('c', p_partkey % 3) AS c", "double(p_size) AS p2p", "double(p_size + 60 * (p_partkey % 3)) AS area", "double(p_size + 60 * (p_partkey % 3)) AS kurt", "double(p_retailprice - IF(p_partkey % 3 = 1, 700, 0)) AS aspect")
    return K.range_overlap_check(rows, "c", ["c0", "c1", "c2"], ["p2p", "area", "kurt", "aspect"], {"kurt"}, {("area", "c2", "c0")})


@R.query("""WITH p AS (SELECT vec_id, vec_id % 10 = 0 AS cut, vec_id % 7 = 0 AS moved FROM embeddings)
SELECT 'vec' || vec_id AS case_id, CASE WHEN cut THEN 'shape' WHEN moved THEN 'affine' ELSE 'ok' END AS geometry, count(*) OVER (PARTITION BY CASE WHEN cut THEN 'shape' WHEN moved THEN 'affine' ELSE 'ok' END) AS n FROM p""")
def geometry_mismatch_report(t):
    """Masks of another shape, and of another affine by more and by less than the tolerance; each case, with its class's count."""
    pairs = t.embeddings.select("vec_id", F.col("embedding").alias("i"), F.size("embedding").alias("si"), (F.size("embedding") - F.expr("IF(vec_id % 10 = 0, 1, 0)")).alias("sm"), F.transform("embedding", lambda v: v + F.expr("IF(vec_id % 7 = 0, 0.002, 0.0004)")).alias("m"))
    found = K.geometry_mismatch(pairs, ("si", "sm"), ("i", "m"))
    counts = found.groupBy("geometry").agg(F.count("*").alias("n"))
    return found.join(counts, "geometry").select(F.concat(F.lit("vec"), "vec_id").alias("case_id"), "geometry", "n")


@R.query("""WITH m AS (SELECT o_custkey AS folder, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey END AS c FROM orders), v AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 45)
SELECT folder, count(c) > 0 AS reviewed, bool_or(k IS NOT NULL) AS filled FROM m LEFT JOIN v ON c = k GROUP BY 1""")
def reviewed_folder_flag(t):
    """Both modes: a folder has a mask, and one that isn't empty."""
    masks = t.orders.selectExpr("o_custkey AS folder", "CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey END AS c")
    voxels = t.lineitem.where("l_quantity > 45").select(F.col("l_orderkey").alias("c"))
    return K.reviewed_folder_flag(masks, "folder", "c").join(K.reviewed_folder_flag(masks, "folder", "c", voxels).withColumnRenamed("reviewed", "filled"), "folder")


@R.query("SELECT l_orderkey, min(q) AS low, max(q) AS high, CASE WHEN count(q) < count(*) THEN 0 ELSE count(DISTINCT q) END AS values FROM (SELECT l_orderkey, CASE WHEN l_linenumber < 6 THEN l_quantity END AS q FROM lineitem) GROUP BY 1")
def bvalue_summary(t):
    return K.bvalue_summary(t.lineitem.selectExpr("l_orderkey", "CASE WHEN l_linenumber < 6 THEN l_quantity END AS q"), "l_orderkey", "q")


_PAIR = """x AS (SELECT a || '|' || b AS pair, level, g, (label = b)::INT AS y, sb - sa AS d FROM (SELECT *, CASE a WHEN '0' THEN s[1] WHEN '1' THEN s[2] ELSE s[3] END AS sa, CASE b WHEN '1' THEN s[2] ELSE s[3] END AS sb FROM
 (SELECT (vec_id % 3)::VARCHAR AS label, vec_id // 4 AS g, vec_id % 2 AS level, list_transform(embedding[1:3], lambda v: v::DOUBLE) AS s FROM embeddings), (VALUES ('0', '1'), ('0', '2'), ('1', '2')) p(a, b) WHERE label IN (a, b))),
h AS (SELECT pair, level, d, sum(y) AS p, sum(1 - y) AS n FROM x GROUP BY ALL), w AS (SELECT *, p * (coalesce(sum(n) OVER (PARTITION BY pair, level ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2.0::DOUBLE) AS w FROM h),
u AS (SELECT pair, level, sum(w) / nullif(sum(p)::DOUBLE * sum(n), 0) AS auc FROM w GROUP BY ALL), z AS (SELECT pair, level, count(DISTINCT g) AS groups, count(*) AS rows FROM x GROUP BY ALL),
e AS (SELECT pair, level, auc, groups, greatest(groups // 2, 2)::DOUBLE AS n FROM u JOIN z USING (pair, level) WHERE rows >= 4 AND auc IS NOT NULL),
f AS (SELECT *, sqrt(greatest(auc * (1 - auc) + (n - 1) * (auc / (2 - auc) + 2 * auc * auc / (1 + auc) - 2 * auc * auc), 0) / (n * n)) AS se FROM e)"""


@R.query(f"WITH {_PAIR} SELECT pair, level, auc, se, greatest(0, auc - 1.96::DOUBLE * se) AS low, least(1, auc + 1.96::DOUBLE * se) AS high, groups, greatest(0, auc - 1.96::DOUBLE * se) > 0.5 AS signal FROM f")
def pairwise_auc(t):
    """Per pair and level of difficulty."""
    rows = t.embeddings.select((F.col("vec_id") % 3).cast("string").alias("label"), F.expr("vec_id DIV 4").alias("g"), (F.col("vec_id") % 2).alias("level"), *[F.get("embedding", F.lit(k)).cast("double").alias(f"s{k}") for k in range(3)])
    return K.pairwise_auc(rows, "label", {str(k): f"s{k}" for k in range(3)}, "g", ["level"])


_WEIGHT = "CASE " + " ".join(f"WHEN u < {limit} THEN {k}" for limit, k in K.poisson_steps()) + f" ELSE {len(K.poisson_steps())} END"


@R.query(f"""WITH x AS (SELECT value AS s, event_type = 'error' AS y, r.r, ('0x' || substr(md5('0:' || r.r || ':' || event_id), 1, 8))::BIGINT AS u FROM events, range(0, 60) r(r) WHERE value IS NOT NULL),
h AS (SELECT r, s, sum(CASE WHEN y THEN {_WEIGHT} ELSE 0 END) AS p, sum(CASE WHEN y THEN 0 ELSE {_WEIGHT} END) AS n FROM x GROUP BY ALL),
w AS (SELECT *, p * (coalesce(sum(n) OVER (PARTITION BY r ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2.0::DOUBLE) AS w FROM h), a AS (SELECT r, sum(w) / nullif(sum(p)::DOUBLE * sum(n), 0) AS auc FROM w GROUP BY 1)
SELECT quantile_cont(auc, 0.025) AS low, quantile_cont(auc, 0.975) AS high, count(auc) AS replicates FROM a""")
def bootstrap_auc_ci(t):
    return K.bootstrap_auc_ci(t.events, F.col("event_type") == "error", "value", "event_id", 60)


@R.query("SELECT l_returnflag, round(avg(l_quantity), 9) AS q, count(*) AS n, max(l_extendedprice) AS high FROM lineitem GROUP BY 1")
def group_collapse(t):
    """By aggregates; a caller's function of a group's rows is the other form (see the tests)."""
    return I.group_collapse(t.lineitem, ["l_returnflag"], {"q": F.round(F.avg("l_quantity"), 9), "n": F.count("*"), "high": F.max("l_extendedprice")})


# ------------------------------------------------------------ geometry


@R.query("""SELECT vec_id, CASE vec_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 5 ELSE CASE WHEN vec_id % 7 > 0 THEN CASE (i, j) WHEN (1, 2) THEN 1 WHEN (1, 3) THEN 2 WHEN (2, 3) THEN 3 ELSE 4 END END END AS code
FROM (SELECT vec_id, list_position(r, list_max(r)) AS i, list_position(c, list_max(c)) AS j FROM (SELECT vec_id, list_transform(embedding[1:3], lambda v: abs(v)) AS r, list_transform(embedding[4:6], lambda v: abs(v)) AS c FROM embeddings))""")
def orientation_code(t):
    rows = t.embeddings.select("vec_id", F.expr("CASE vec_id % 5 WHEN 0 THEN '3D' WHEN 1 THEN '4D' ELSE '2D' END").alias("acq"), F.expr("CASE WHEN vec_id % 7 > 0 THEN slice(embedding, 1, 6) END").alias("o"))
    return rows.select("vec_id", V.orientation_code("acq", "o").alias("code"))


#: Header rows of two series per supplier derived from order lines; files may share a position.
HEAD = [
    "l_suppkey AS series", "CAST(l_partkey % 5 AS INT) AS px", "CAST(l_linenumber AS INT) AS py", "CAST(l_partkey % 3 AS INT) AS pz", "concat(lpad(CAST(l_orderkey AS STRING), 9, '0'), '-', CAST(l_linenumber AS STRING), '-', lpad(CAST(l_partkey AS STRING), 9, '0'), '-', CAST(l_extendedprice AS STRING)) AS file",
    "CASE WHEN l_suppkey % 4 = 0 THEN l_quantity END AS b", "CASE WHEN l_suppkey % 4 = 1 THEN l_extendedprice END AS acquired", "CASE WHEN l_suppkey % 4 = 2 THEN l_tax END AS content", "CASE WHEN l_suppkey % 4 = 3 AND l_suppkey % 8 = 3 THEN concat('orig\\\\', l_returnflag, 'ater') ELSE 'q' END AS image_type",
]
_KIND = "coalesce(" + ", ".join(f"CASE WHEN contains(upper(image_type), '{k}') THEN {i} END" for i, k in enumerate(V.IMAGE_TYPES)) + ")"


@R.query("WITH head AS (SELECT " + ", ".join(HEAD).replace("\\\\\\\\", "\\") + f""" FROM lineitem),
s AS (SELECT series, [max(px) - min(px), max(py) - min(py), max(pz) - min(pz)] AS s FROM head GROUP BY 1), d AS (SELECT DISTINCT series, px, py, pz FROM head),
m AS (SELECT series, px, py, pz, count(*) OVER (PARTITION BY series) AS positions, row_number() OVER (PARTITION BY series ORDER BY [px, py, pz][list_position(s, list_max(s))], px, py, pz) AS k FROM d JOIN s USING (series)),
f AS (SELECT h.*, positions, {_KIND} AS kind FROM head h JOIN m USING (series, px, py, pz) WHERE k = positions // 2 + 1),
r AS (SELECT *, count(*) OVER e AS volumes, count(acquired) OVER e AS na, count(content) OVER e AS nc, count(kind) OVER e AS nk, count(DISTINCT b) OVER e AS nb, row_number() OVER (PARTITION BY series ORDER BY b NULLS LAST, file) AS rb,
 row_number() OVER (PARTITION BY series ORDER BY acquired NULLS LAST, file) AS ra, row_number() OVER (PARTITION BY series ORDER BY content NULLS LAST, file) AS rc, row_number() OVER (PARTITION BY series ORDER BY kind NULLS LAST, file) AS rk, row_number() OVER (PARTITION BY series ORDER BY file) AS rf FROM f WINDOW e AS (PARTITION BY series))
SELECT series, file, positions, volumes FROM r WHERE CASE WHEN nb > 1 THEN rb = volumes // 2 + 1 WHEN na = volumes THEN ra = volumes // 2 + 1 WHEN nc = volumes THEN rc = volumes // 2 + 1 WHEN nk > 0 THEN rk = 1 ELSE rf = volumes // 2 + 1 END""")
def middle_slice_pick(t):
    return V.middle_slice_pick(t.lineitem.selectExpr(*HEAD), "series", ("px", "py", "pz"), "file", "b", "acquired", "content", "image_type")


_LINES = "SELECT l_orderkey AS case_id, l_linenumber AS x, CASE WHEN l_quantity > 30 THEN l_linenumber ELSE 0 END AS label FROM lineitem"


@R.query(f"SELECT case_id, count_if(label > 0) AS foreground, count_if(label > 0) = 0 AS dropped, count(DISTINCT CASE WHEN label > 0 THEN x END) AS kept FROM ({_LINES}) GROUP BY 1")
def binarize_mask(t):
    """Labels over 0 become 1; the cases that have none are dropped and counted."""
    voxels = t.lineitem.selectExpr("l_orderkey AS case_id", "l_linenumber AS x", "CASE WHEN l_quantity > 30 THEN l_linenumber ELSE 0 END AS label")
    kept = V.binarize_mask(voxels, ["case_id"], ["x"], "label").groupBy("case_id").agg(F.sum("label").alias("kept"))
    return V.foreground_counts(voxels, ["case_id"], "label").join(kept, "case_id", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))


@R.query(f"""{VX}, m AS (SELECT DISTINCT case_id, x, y, z FROM vox WHERE label = 1), c AS (SELECT DISTINCT case_id, (ascii(case_id) % 2 + 1)::DOUBLE AS f FROM vox),
g AS (SELECT case_id, f, x, y, unnest(range(0, 8))::INT AS z FROM (SELECT case_id, f, x, unnest(range(0, 8))::INT AS y FROM (SELECT case_id, f, unnest(range(0, 11))::INT AS x FROM c)))
SELECT g.case_id, g.x, g.y, g.z, (m.x IS NOT NULL AND round_even((g.x * 2 * f + 1) / f, 0) < 19)::INT AS label FROM g LEFT JOIN m ON m.case_id = g.case_id AND m.x = round_even((g.x * 2 * f + 1) / f, 0)::INT AND m.y = round_even((3 - g.y * f + 4 * f) / f, 0)::INT AND m.z = g.z + 1""")
def reindex_voxels(t):
    """Images of another spacing, origin and direction than their masks, by case."""
    m = shapes.voxels(t).where("label = 1").select("case_id", "x", "y", "z").distinct().withColumn("label", F.lit(1))
    f = shapes.voxels(t).select("case_id").distinct().withColumn("f", F.expr("double(ascii(case_id) % 2 + 1)"))
    images = f.select("case_id", F.array(F.lit(11), F.lit(8), F.lit(8)).alias("shape"), F.expr("array(2 * f, 0D, 0D, 1D, 0D, -f, 0D, 3D + 4 * f, 0D, 0D, 1D, 1D)").alias("affine"))
    masks = f.select("case_id", F.array(F.lit(19), F.lit(16), F.lit(20)).alias("shape"), F.expr("array(f, 0D, 0D, 0D, 0D, f, 0D, 0D, 0D, 0D, 1D, 0D)").alias("affine"))
    return V.reindex_voxels(images, masks, m, ["case_id"])


@R.query(f"""{VX}, s AS (SELECT case_id, max(x) + 1 AS sx, max(y) + 1 AS sy, max(z) + 1 AS sz FROM vox GROUP BY 1), m AS (SELECT case_id, (x - (sx - 15) // 2)::INT AS x, (y + (21 - sy) // 2)::INT AS y, (z - (sz - 5) // 2)::INT AS z, value FROM vox JOIN s USING (case_id))
SELECT case_id, x, y, z, value FROM m WHERE x BETWEEN 0 AND 14 AND y BETWEEN 0 AND 20 AND z BETWEEN 0 AND 4""")
def center_crop_pad(t):
    """Cropped along x and z, padded along y."""
    v = shapes.voxels(t)
    sizes = v.groupBy("case_id").agg(F.array(F.max("x") + 1, F.max("y") + 1, F.max("z") + 1).alias("shape"))
    return V.center_crop_pad(v, sizes, ["case_id"], ["x", "y", "z"], [15, 21, 5]).select("case_id", "x", "y", "z", "value")


_BOX = "min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1"


@R.query(f"{VX} SELECT case_id, {_BOX} FROM vox WHERE label = 1 GROUP BY 1")
def mask_box(t):
    return V.mask_box(shapes.voxels(t).where("label = 1"), ["case_id"])


@R.query(f"{VX} SELECT {_BOX} FROM vox WHERE label = 1")
def union_box(t):
    return V.union_box(V.mask_box(shapes.voxels(t).where("label = 1"), ["case_id"]), [])


@R.query("WITH b AS (SELECT l_orderkey, min(l_suppkey) AS x0, max(l_suppkey) AS x1 FROM lineitem GROUP BY 1) SELECT l_orderkey, x0 - 2 AS x0, x1 + 2 AS x1 FROM b")
def expand_box(t):
    boxes = V.mask_box(t.lineitem.select("l_orderkey", F.col("l_suppkey").alias("x")), ["l_orderkey"], ("x",))
    return V.expand_box(boxes, {"x": V.margin_to_px(12.5, F.lit(5.0))})


@R.query(f"""{VX}, b AS (SELECT case_id, min(x) AS x0, max(x) AS x1 FROM vox WHERE label = 1 GROUP BY 1), a AS (SELECT case_id, z AS slice, count(*) AS area FROM vox WHERE label = 1 GROUP BY ALL), s AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY area DESC, slice DESC) <= 2)
SELECT case_id, slice, x0 - 2 AS x0, x1 + 2 AS x1, area FROM b JOIN s USING (case_id)""")
def crop_manifest(t):
    mask = shapes.voxels(t).where("label = 1")
    box = V.expand_box(V.mask_box(mask, ["case_id"], ("x",)), {"x": F.lit(2)})
    return box.join(V.topk_slices(V.slice_areas(mask, ["case_id"], "z"), ["case_id"], 2).drop("rank"), "case_id")


@R.query(f"{VX}, b AS (SELECT case_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM vox WHERE value > 49 GROUP BY 1) SELECT case_id, x, unnest(range(y0, y1 + 1))::INT AS y FROM (SELECT case_id, y0, y1, unnest(range(x0, x1 + 1))::INT AS x FROM b)")
def box_fill_mask(t):
    return V.box_fill_mask(V.mask_box(shapes.voxels(t).where("value > 49"), ["case_id"], ("x", "y")), ["case_id"])


_HD = "d AS (SELECT a.case_id, a.x AS ax, a.y AS ay, b.x AS b_x, b.y AS b_y, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM a JOIN b ON a.case_id = b.case_id), n AS (SELECT case_id, min(d) AS d FROM d GROUP BY case_id, ax, ay UNION ALL SELECT case_id, min(d) FROM d GROUP BY case_id, b_x, b_y)"


@R.query(f"WITH v AS (SELECT l_suppkey % 30 AS case_id, l_partkey % 60 AS x, l_linenumber * 3 AS y, l_quantity AS q FROM lineitem), a AS (SELECT DISTINCT case_id, x, y FROM v WHERE q > 45), b AS (SELECT DISTINCT case_id, x, y FROM v WHERE q < 5), {_HD} SELECT case_id, quantile_cont(d, 0.95) AS hd95 FROM n GROUP BY 1")
def hd95(t):
    v = t.lineitem.selectExpr("l_suppkey % 30 AS case_id", "l_partkey % 60 AS x", "l_linenumber * 3 AS y", "l_quantity AS q")
    return V.hd95(v.where("q > 45"), v.where("q < 5"), ["case_id"], ["x", "y"])


@R.query(f"""{VX}, p AS (SELECT DISTINCT case_id, x, y FROM vox WHERE label = 1), c AS (SELECT case_id, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY 1),
b AS (SELECT case_id, least(floor((atan2(y - cy, x - cx) + {math.pi}::DOUBLE) / {2 * math.pi}::DOUBLE * 36), 35)::INT AS bin, max(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))) AS r FROM p JOIN c USING (case_id) GROUP BY 1, 2),
g AS (SELECT case_id, unnest(range(0, 36))::INT AS bin FROM c), j AS (SELECT g.case_id, g.bin, r FROM g LEFT JOIN b ON g.case_id = b.case_id AND g.bin = b.bin),
f AS (SELECT case_id, bin, coalesce(last_value(r IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), last_value(r IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS f FROM j)
SELECT case_id, bin, f / avg(f) OVER (PARTITION BY case_id) AS radius FROM f""")
def radial_profile(t):
    return V.radial_profile(shapes.voxels(t).where("label = 1").select("case_id", "x", "y").distinct(), ["case_id"])


_CURVE = "c AS (SELECT vec_id, i, 3 + v AS v FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) WHERE i < 32)"


@R.query(f"""WITH {_CURVE}, h AS (SELECT vec_id, k, round(2.0::DOUBLE / 32 * sqrt(pow(sum(v * cos(k * i * {2 * math.pi / 32}::DOUBLE)), 2) + pow(sum(v * sin(k * i * {2 * math.pi / 32}::DOUBLE)), 2)), 12) AS a FROM c, range(1, 17) r(k) GROUP BY 1, 2),
m AS (SELECT vec_id, avg(v) AS m FROM c GROUP BY 1), s AS (SELECT vec_id, avg(pow(v - m, 2)) AS m2, avg(pow(v - m, 4)) AS m4, max(v) - min(v) AS ptp, avg(v * v) AS mean_sq FROM c JOIN m USING (vec_id) GROUP BY 1)
SELECT vec_id, dom_k::INT AS dom_k, m4 / (m2 * m2) AS kurtosis, ptp, mean_sq FROM s JOIN (SELECT vec_id, arg_min(k, (-a, k)) AS dom_k FROM h GROUP BY 1) USING (vec_id)""")
def shape_descriptors(t):
    curve = t.embeddings.select("vec_id", F.posexplode(F.slice("embedding", 1, 32)).alias("i", "v")).withColumn("v", F.col("v").cast("double") + 3)
    return V.shape_descriptors(curve, ["vec_id"], "i", "v", 32)


@R.query("SELECT p_brand, min(p_size)::DOUBLE AS sx, min(p_retailprice) AS sy, min(p_partkey % 17)::DOUBLE AS sz FROM part GROUP BY 1")
def finest_spacing(t):
    images = t.part.select("p_brand", F.array(F.col("p_size").cast("double"), "p_retailprice", (F.col("p_partkey") % 17).cast("double")).alias("spacing"))
    return V.finest_spacing(images, ["p_brand"], "spacing").select("p_brand", *[F.get("spacing", F.lit(k)).alias(n) for k, n in enumerate(("sx", "sy", "sz"))])


@R.query("SELECT p_partkey, p_brand AS modality, ['axial', 'coronal', 'sagittal'][p_partkey % 3 + 1] AS plane, p_size AS slice FROM part WHERE p_partkey % 5 > 0 UNION ALL SELECT p_partkey, NULL, NULL, NULL FROM part WHERE p_partkey % 5 = 0")
def parse_file_name(t):
    name = F.expr("concat(p_brand, '_', CASE WHEN p_partkey % 5 = 0 THEN 'oblique' ELSE element_at(array('axial', 'coronal', 'sagittal'), CAST(p_partkey % 3 + 1 AS INT)) END, '_', p_size, '.png')")
    return t.part.select("p_partkey", A.parse_file_name(name).alias("x")).select("p_partkey", "x.*")


# ------------------------------------------------------------ scores and functions of rows


@R.query(f"{T}, m AS (SELECT lang, avg((pred = quality)::INT::DOUBLE) AS accuracy FROM truth GROUP BY 1) SELECT lang, accuracy, CASE WHEN accuracy >= 0.55::DOUBLE THEN 'PASS' ELSE 'FAIL' END AS gate FROM m")
def gate_check(t):
    return C.gate_check(K.overall_accuracy(truth(t), "quality", "pred", ["lang"]).drop("n"), "accuracy", 0.55)


#: Properties, not values, are compared for fitted models: see the tests.
R.query(None, key="marginal_matching")(lambda t: C.marginal_matching(shapes.long_scores(t), "vec_id", "c", "s")[0])


@R.query(None)
def linear_probe(t):
    return C.linear_probe(t.embeddings.select("vec_id", (F.col("label") % 3).alias("label"), "embedding"), "embedding", "label", "vec_id", 3).select("task", "vec_id", "label", "fold", "predicted")


@R.query(None)
def matrix_scaling(t):
    """Scores of the three classes, as softmax gives them."""
    wide = t.embeddings.select("vec_id", (F.col("vec_id") % 3).alias("label"), *[F.get("embedding", F.lit(k)).cast("double").alias(f"s{k}") for k in range(3)])
    return C.matrix_scaling(wide, ["s0", "s1", "s2"], "label", "vec_id", 3).select("vec_id", "label", "fold", "predicted")


@R.query("SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'dear' ELSE 'cheap' END AS size, o_orderstatus || '/' || (o_orderkey % 2) AS tag FROM orders")
def row_label_udf(t):
    return I.row_label_udf(t.orders, _labels, ["o_totalprice", "o_orderstatus", "o_orderkey"], "size string, tag string").select("o_orderkey", "labels.*")


def _labels(rows: pd.DataFrame) -> pd.DataFrame:
    """A caller's rule over whole batches."""
    return pd.DataFrame({"size": (rows["o_totalprice"] > 150000).map({True: "dear", False: "cheap"}), "tag": rows["o_orderstatus"] + "/" + (rows["o_orderkey"] % 2).astype(str)})


@R.query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus || '!' END AS raw_output FROM orders")
def registry_infer(t):
    """Rows whose model fails keep a null answer."""
    return I.registry_infer(t.orders.select("o_orderkey", "o_orderstatus"), {"shout": shapes._shout}, "shout", "o_orderkey").select("o_orderkey", "raw_output")


@R.query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN '{"answer": "' || upper(event_type) || '", "reason": "r"}' WHEN 1 THEN '```json' || chr(10) || '{"answer": "' || event_type || '"}' || chr(10) || '```'
WHEN 3 THEN 'I say ' || event_type || '.' WHEN 4 THEN 'click or view' WHEN 5 THEN 'answer: ' || event_type ELSE '' END AS region FROM events""")
def answer_region(t):
    return labels.replies(t).select("event_id", P.answer_region("reply").alias("region"))


# ------------------------------------------------------------ whole tables in order


@R.query("SELECT coalesce(s_suppkey, c_custkey) AS id, s_name, c_name FROM supplier FULL JOIN customer ON s_suppkey = c_custkey")
def join_outer_coalesce_key(t):
    return J.join_outer_coalesce_key(t.supplier.select("s_suppkey", "s_name"), t.customer.select("c_custkey", "c_name"), "s_suppkey", "c_custkey", "id")


@R.query("SELECT o_orderkey FROM orders ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT 30")
def sample_rows(t):
    """A sample of a fixed size is the feature."""
    return W.sample_rows(t.orders, "o_orderkey", 30, 7).select("o_orderkey")


@R.query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey")
def sort_stable_multi(t):
    return t.orders.orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_orderpriority", "o_totalprice")


@R.query("SELECT c_mktsegment, n FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1) ORDER BY c_mktsegment = 'BUILDING', n DESC")
def sort_custom_rank(t):
    return t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n")).orderBy(F.col("c_mktsegment") == "BUILDING", F.desc("n"))


@R.query("SELECT c_custkey, v FROM (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS v FROM customer) ORDER BY v NULLS LAST, c_custkey")
def sort_nulls_last(t):
    return t.customer.selectExpr("c_custkey", "CASE WHEN c_acctbal > 0 THEN c_acctbal END AS v").orderBy(F.asc_nulls_last("v"), "c_custkey")


QUERIES, ORACLE = R.queries, R.oracle
