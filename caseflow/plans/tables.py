"""Queries of scans, projections, joins, merges, set operations, ranking and cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import metrics as K
from ..operators import rows as W
from .registry import Registry, Tables

R = Registry()

#: Two methods per order: its status, and the last status of its lines.
S = "WITH status AS (SELECT o_orderkey, o_custkey, o_orderstatus AS a, b FROM orders JOIN (SELECT l_orderkey, max(l_linestatus) AS b FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey)"


def status(t: Tables) -> DataFrame:
    """Statuses are single letters: their codes have a maximum in a hash aggregation, strings only in a sorted one."""
    last = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.char(F.max(F.ascii("l_linestatus"))).alias("b"))
    return J.join_methods_inner(t.orders.select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("a")), last, ["o_orderkey"])


@R.query("SELECT r_regionkey, r_name FROM region")
def scan_table(t):
    return t.region.select("r_regionkey", "r_name")


R.query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders", key="scan_project_rename")(lambda t: t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price")))

# ------------------------------------------------------------ projections and filters
R.query("SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation", key="rename_columns")(lambda t: t.nation.withColumnsRenamed({"n_nationkey": "id", "n_name": "name", "n_regionkey": "region"}))
R.query("SELECT n_nationkey AS n_regionkey, n_regionkey AS n_nationkey, n_name FROM nation", key="swap_columns")(lambda t: W.swap_columns(t.nation, "n_nationkey", "n_regionkey"))
R.query("SELECT n_name FROM nation", key="select_existing")(lambda t: W.select_existing(t.nation, ["n_name", "absent"]))
R.query("SELECT n_name, n_regionkey FROM nation", key="require_columns")(lambda t: W.require_columns(t.nation, ["n_name"]).select("n_name", "n_regionkey"))
R.query("SELECT n_name, n_nationkey, n_regionkey FROM nation", key="reorder_columns")(lambda t: W.reorder_columns(t.nation, ["n_name"]))
R.query("SELECT n_name FROM nation", key="drop_columns")(lambda t: t.nation.drop("n_nationkey", "n_regionkey"))
R.query("SELECT n_nationkey, n_name, n_regionkey, '' AS viewed FROM nation", key="default_columns")(lambda t: W.default_columns(t.nation, {"viewed": F.lit(""), "n_name": F.lit("x")}))
R.query("SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('P')", key="filter_exclude_values")(lambda t: W.exclude_values(t.orders, "o_orderstatus", ["P"]).select("o_orderkey"))
R.query("SELECT p_partkey FROM part WHERE trim(p_name) <> '' AND trim(p_type) <> ''", key="filter_required_nonblank")(lambda t: W.required_nonblank(t.part, ["p_name", "p_type"]).select("p_partkey"))
R.query("SELECT o_orderkey, o_totalprice > 200000 AS dear, o_orderstatus = 'P' AS open, o_totalprice > 200000 OR o_orderstatus = 'P' AS excluded FROM orders", key="exclusion_flags")(lambda t: W.exclusion_flags(t.orders, {"dear": F.col("o_totalprice") > 200000, "open": F.col("o_orderstatus") == "P"}).select("o_orderkey", "dear", "open", "excluded"))
R.query("SELECT o_orderkey FROM orders WHERE ('0x' || substr(md5('0:' || o_orderkey), 1, 8))::BIGINT % 4 = 1", key="strided_shard")(lambda t: W.strided_shard(t.orders, "o_orderkey", 4, 1).select("o_orderkey"))
R.query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", key="leakage_guard")(lambda t: W.leakage_guard(t.orders, t.orders.where("o_totalprice > 300000"), "o_custkey").select("o_orderkey"))

# ------------------------------------------------------------ joins
R.query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) ON c_custkey = o_custkey", key="join_left_one_to_one")(lambda t: J.join_left_one_to_one(t.customer.select("c_custkey"), t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("o_orderkey")), ["c_custkey"]))
R.query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1) ON c_custkey = o_custkey", key="join_left_first_match")(lambda t: J.join_left_first_match(t.customer.select("c_custkey"), t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate"), ["c_custkey"], ["o_orderdate", "o_orderkey"]).select("c_custkey", "o_orderkey"))
R.query("SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey", key="join_inner_renamed_key")(lambda t: J.join_inner_renamed_key(t.nation, t.region, "n_regionkey", "r_regionkey"))
R.query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)", key="join_semi_members")(lambda t: J.semi_members(t.customer.select("c_custkey"), t.orders.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]))
R.query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)", key="join_anti_members")(lambda t: J.anti_members(t.customer.select("c_custkey"), t.orders.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]))
R.query("SELECT s_suppkey, coalesce(n_name, 'none') AS n_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON s_nationkey = n_nationkey", key="join_lookup_map")(lambda t: J.lookup(t.supplier.select("s_suppkey", F.col("s_nationkey").alias("n_nationkey")), F.broadcast(t.nation.where("n_nationkey % 2 = 0")), "n_nationkey", "n_name", F.lit("none")).select("s_suppkey", "n_name"))
R.query("SELECT a.o_orderkey, a.o_orderstatus AS o_orderstatus_a, b.l_linestatus AS o_orderstatus_b FROM orders a JOIN lineitem b ON a.o_orderkey = b.l_orderkey AND b.l_linenumber = 1", key="join_two_runs")(lambda t: J.two_runs(t.orders, t.lineitem.where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linestatus").alias("o_orderstatus")), ["o_orderkey"], "o_orderstatus"))
R.query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'", key="join_left_then_filter")(lambda t: t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").where("c_mktsegment = 'BUILDING'").select("o_orderkey", "c_name"))
_FIX = "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'fixed' WHEN p_partkey % 4 = 1 THEN ' ' END AS p_brand FROM part WHERE p_partkey % 2 < 2 AND p_partkey % 3 = 0"
R.query(f"SELECT p.p_partkey, p.p_brand AS p_brand_orig, coalesce(nullif(trim(f.p_brand), ''), p.p_brand) AS p_brand FROM part p LEFT JOIN ({_FIX}) f USING (p_partkey)", key="patch_overrides")(lambda t: J.patch_overrides(t.part.select("p_partkey", "p_brand"), t.part.where("p_partkey % 3 = 0").selectExpr("p_partkey", "CASE WHEN p_partkey % 4 = 0 THEN 'fixed' WHEN p_partkey % 4 = 1 THEN ' ' END AS p_brand"), "p_partkey", "p_brand"))
R.query("SELECT p.p_partkey, coalesce(f.n, p.p_brand) AS p_brand, coalesce(f.n <> p.p_brand, false) AS conflict FROM part p LEFT JOIN (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'fixed' END AS n FROM part WHERE p_partkey % 2 = 0) f USING (p_partkey)", key="merge_with_conflicts")(lambda t: J.merge_with_conflicts(t.part.select("p_partkey", "p_brand"), t.part.where("p_partkey % 2 = 0").selectExpr("p_partkey", "CASE WHEN p_partkey % 4 = 0 THEN 'fixed' END AS p_brand"), "p_partkey", "p_brand"))
R.query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'X' ELSE coalesce(nullif(CASE WHEN p_partkey % 2 = 0 THEN 'n' ELSE '' END, ''), 'o') END AS mark FROM part", key="merge_selections")(lambda t: J.merge_selections(t.part.selectExpr("p_partkey", "CASE WHEN p_partkey % 2 = 0 THEN 'n' ELSE '' END AS mark"), t.part.selectExpr("p_partkey", "CASE WHEN p_partkey % 3 = 0 THEN 'X' ELSE 'o' END AS mark"), "p_partkey", "mark", "X"))
R.query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size::DOUBLE ELSE p_retailprice END AS v FROM part WHERE p_partkey % 12 <> 0", key="fill_from_manual")(lambda t: J.fill_from_manual(t.part.selectExpr("p_partkey", "CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice END AS v"), t.part.where("p_partkey % 3 = 0").selectExpr("p_partkey", "CASE WHEN p_partkey % 4 = 0 THEN 'n/a' ELSE CAST(p_size AS STRING) END AS note"), "p_partkey", "v", "note"))
_VISITS = "SELECT user_id AS subject, strftime(ts, '%Y%m%d') AS session, ts::DATE AS d, count(*) AS files FROM events GROUP BY ALL"
R.query(f"""WITH r AS (SELECT o_custkey AS subject, o_orderkey, o_orderdate::DATE AS od FROM orders), v AS ({_VISITS}),
b AS (SELECT o_orderkey, v.files, v.session FROM v JOIN r USING (subject) QUALIFY row_number() OVER (PARTITION BY v.subject, v.session ORDER BY abs(date_diff('day', od, d)), o_orderkey) = 1)
SELECT r.subject, r.o_orderkey, h.files, h.session FROM r LEFT JOIN (SELECT o_orderkey, sum(files)::BIGINT AS files, max(session) AS session FROM b GROUP BY 1) h USING (o_orderkey)""", key="nearest_date_join")(lambda t: J.nearest_date_join(t.orders.select(F.col("o_custkey").alias("subject"), "o_orderkey", F.col("o_orderdate").cast("date").alias("od")), t.events.groupBy(F.col("user_id").alias("subject"), F.date_format("ts", "yyyyMMdd").alias("session"), F.col("ts").cast("date").alias("d")).agg(F.count("*").alias("files")), "subject", "o_orderkey", "od", "session", "d", ["files"]).select("subject", "o_orderkey", "files", "session"))
R.query("SELECT coalesce(o.k, l.k) AS k, CASE WHEN o.k IS NOT NULL AND l.k IS NULL THEN 'recorded_only' WHEN o.k IS NULL THEN 'unrecorded_mark' ELSE 'agree' END AS status FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 > 0) o FULL JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey % 4 > 0) l ON o.k = l.k", key="reconcile_sources")(lambda t: J.reconcile(t.orders.where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("k"), F.lit(True).alias("r")), t.lineitem.where("l_orderkey % 4 > 0").select(F.col("l_orderkey").alias("k"), F.lit(True).alias("d")).distinct(), "k", "r", "d"))
R.query("SELECT l_orderkey, l_linenumber, coalesce(o_orderstatus, 'unmapped') AS o_orderstatus FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 2 = 0) ON l_orderkey = o_orderkey", key="composite_key_lookup")(lambda t: J.lookup(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber"), t.orders.where("o_orderkey % 2 = 0"), "o_orderkey", "o_orderstatus", F.lit("unmapped")).select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "o_orderstatus"))
R.query("SELECT c, l, n FROM (SELECT DISTINCT l_orderkey AS c FROM lineitem), (VALUES (1), (2), (9)) v(l) LEFT JOIN (SELECT l_orderkey, l_linenumber, l_partkey AS n FROM lineitem) ON c = l_orderkey AND l = l_linenumber", key="resolve_requirements")(lambda t: J.resolve_requirements(t.lineitem.select(F.col("l_orderkey").alias("c")), t.spark.createDataFrame([(1,), (2,), (9,)], "l int"), t.lineitem.select(F.col("l_orderkey").alias("c"), F.col("l_linenumber").alias("l"), F.col("l_partkey").alias("n")), "c", ["l"], "n"))
R.query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'disk/a/b/' || page_id END AS found FROM pages", key="path_suffix_match")(lambda t: J.path_suffix_match(t.pages.selectExpr("page_id", "concat('old/a/b/', page_id) AS path"), t.pages.where("page_id % 2 = 0").selectExpr("concat('disk/a/b/', page_id) AS path"), "path").select("page_id", "found"))

# ------------------------------------------------------------ ranking, dedupe and cohorts
R.query("SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text", key="dedupe_keep_first")(lambda t: W.dedupe_keep_first(t.documents, ["text"], ["doc_id"]).select("doc_id", "text"))
R.query("SELECT max(doc_id) AS doc_id, text FROM documents GROUP BY text", key="dedupe_keep_last")(lambda t: W.dedupe_keep_first(t.documents, ["text"], [F.desc("doc_id")]).select("doc_id", "text"))
R.query("SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag <> 'R', l_linenumber) = 1", key="best_candidate")(lambda t: J.first_per_key(t.lineitem, ["l_orderkey"], [F.col("l_returnflag") != "R", "l_linenumber"]).select("l_orderkey", "l_linenumber"))


def _sizes(t: Tables) -> DataFrame:
    return t.customer.groupBy(F.col("c_mktsegment").alias("g")).agg(F.count("*").alias("size"))


_ALLOC = """sizes AS (SELECT c_mktsegment AS g, count(*) AS size FROM customer GROUP BY 1),
a AS (SELECT *, least(greatest(floor(size * 97 / sum(size) OVER ()), least(size, 10)), size)::BIGINT AS a, least(size, 10) AS f FROM sizes),
d AS (SELECT *, 97 - sum(a) OVER () AS d, coalesce(sum(size - a) OVER (ORDER BY size - a DESC, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rb, coalesce(sum(a - f) OVER (ORDER BY a - f DESC, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sb FROM a),
alloc AS (SELECT g, size, (a + CASE WHEN d > 0 THEN greatest(0, least(size - a, d - rb)) ELSE -greatest(0, least(a - f, -d - sb)) END)::BIGINT AS alloc FROM d)"""
R.query(f"WITH {_ALLOC} SELECT g, size, alloc FROM alloc", key="stratified_alloc")(lambda t: W.stratified_alloc(_sizes(t), "g", "size", 97, 10))
R.query("WITH s AS (SELECT c_mktsegment AS g, count(*) AS size FROM customer GROUP BY 1) SELECT g, size, CASE WHEN size <= 1400.0::DOUBLE / count(*) OVER () THEN size ELSE floor(1400.0::DOUBLE / count(*) OVER ()) END::BIGINT AS alloc FROM s", key="even_split_alloc")(lambda t: W.even_split_alloc(_sizes(t), "g", "size", 1400))
R.query(f"WITH {_ALLOC} SELECT c_custkey FROM (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) JOIN alloc ON c_mktsegment = g WHERE rn <= alloc", key="stratified_pick")(lambda t: W.stratified_pick(t.customer.withColumnRenamed("c_mktsegment", "g"), W.stratified_alloc(_sizes(t), "g", "size", 97, 10), "g", [F.desc("c_acctbal"), "c_custkey"]).select("c_custkey"))
R.query("(SELECT c_custkey FROM customer WHERE c_custkey % 100 = 0) UNION ALL (SELECT c_custkey FROM customer WHERE c_custkey % 100 <> 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 40 - (SELECT count(*) FROM customer WHERE c_custkey % 100 = 0))", key="shortfall_fill")(lambda t: W.shortfall_fill(t.customer, t.customer.where("c_custkey % 100 = 0"), "c_custkey", [F.desc("c_acctbal"), "c_custkey"], 40).select("c_custkey"))
R.query(f"WITH {_ALLOC} SELECT g, size AS pool, alloc AS selected, size - alloc AS gap, size = alloc AS whole FROM alloc", key="cohort_report")(lambda t: W.stratified_alloc(_sizes(t), "g", "size", 97, 10).select("g", F.col("size").alias("pool"), F.col("alloc").alias("selected"), (F.col("size") - F.col("alloc")).alias("gap"), (F.col("size") == F.col("alloc")).alias("whole")))
R.query("SELECT conv_id, string_agg(role, ';' ORDER BY turn) AS items, list(role ORDER BY turn)[count(*) // 2 + 1] AS middle FROM conversations GROUP BY conv_id HAVING count(*) = max(turn) - min(turn) + 1", key="ordered_run")(lambda t: W.ordered_run(t.conversations.join(t.conversations.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1).alias("n")), "conv_id"), ["conv_id"], "turn", "role", "n").select("conv_id", F.array_join("items", ";").alias("items"), "middle"))
R.query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20", key="worst_n")(lambda t: t.orders.orderBy("o_totalprice", "o_orderkey").limit(20).select("o_orderkey", "o_totalprice"))
R.query("SELECT o_orderkey, CASE (row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('0:' || o_orderkey), o_orderkey) - 1) % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'y' ELSE 'z' END AS class FROM orders", key="balanced_assign")(lambda t: W.balanced_assign(t.orders, "o_orderkey", ["x", "y", "z"], "o_orderstatus").select("o_orderkey", "class"))
R.query("SELECT o_orderkey, o_custkey, (('0x' || substr(md5('0:' || o_custkey), 1, 8))::BIGINT % 5)::INT AS fold FROM orders", key="group_kfold")(lambda t: W.group_kfold(t.orders, "o_custkey", 5).select("o_orderkey", "o_custkey", "fold"))
R.query("SELECT o_orderkey, CASE WHEN ('0x' || substr(md5('0:' || o_orderkey), 1, 8))::BIGINT % 10000 < 2000 THEN 'val' ELSE 'train' END AS part FROM orders", key="train_val_split")(lambda t: W.train_val_split(t.orders, "o_orderkey", 0.2).select("o_orderkey", "part"))
R.query("SELECT p_partkey FROM (SELECT *, max(p_size) OVER (PARTITION BY p_brand) AS m FROM part) WHERE p_size = m QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY md5('0:' || p_partkey), p_partkey) <= 2", key="exemplar_select")(lambda t: W.exemplar_select(t.part, "p_brand", "p_size", "p_partkey", 2).select("p_partkey"))
R.query("WITH x AS (SELECT o_custkey, o_orderdate FROM orders WHERE o_orderstatus = 'P'), w AS (SELECT o_custkey FROM x JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) USING (o_custkey) WHERE n = 1) SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM w) AND (o_custkey, o_orderdate) NOT IN (SELECT (o_custkey, o_orderdate) FROM x)", key="exclusion_escalate")(lambda t: W.exclusion_escalate(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), t.orders.where("o_orderstatus = 'P'").select("o_custkey", "o_orderdate"), "o_custkey", "o_orderdate").select("o_orderkey"))
R.query("SELECT l_orderkey, CASE WHEN row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey) = 1 THEN concat_ws('__', l_suppkey, l_linenumber) ELSE concat_ws('__', l_suppkey, l_linenumber, l_orderkey) END AS case_id FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber FROM lineitem)", key="unique_case_id")(lambda t: W.unique_case_id(t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber"), "l_suppkey", "l_orderkey", "l_linenumber").select("l_orderkey", "case_id"))
R.query("SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'dropped' WHEN a.s <> b.s OR a.p <> b.p THEN 'rerun' ELSE 'copied' END AS status, CASE WHEN a.k IS NULL OR b.k IS NULL THEN '' ELSE concat_ws(';', CASE WHEN a.s <> b.s THEN 's' END, CASE WHEN a.p <> b.p THEN 'p' END) END AS changed FROM (SELECT p_partkey AS k, p_size AS s, p_brand AS p FROM part WHERE p_partkey % 5 > 0) a FULL JOIN (SELECT p_partkey AS k, p_size + (p_partkey % 3 = 0)::INT AS s, CASE WHEN p_partkey % 4 = 0 THEN 'z' ELSE p_brand END AS p FROM part WHERE p_partkey % 6 > 0) b ON a.k = b.k", key="version_diff")(lambda t: W.version_diff(t.part.where("p_partkey % 5 > 0").selectExpr("p_partkey AS k", "p_size AS s", "p_brand AS p"), t.part.where("p_partkey % 6 > 0").selectExpr("p_partkey AS k", "p_size + CAST(p_partkey % 3 = 0 AS INT) AS s", "CASE WHEN p_partkey % 4 = 0 THEN 'z' ELSE p_brand END AS p"), "k", ["s", "p"]))

# ------------------------------------------------------------ sorts, limits, sets
R.query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10", key="limit_rows")(lambda t: t.orders.orderBy("o_orderkey").limit(10).select("o_orderkey"))
R.query("SELECT o_orderstatus, o_orderkey, count(*) OVER (PARTITION BY o_orderstatus) - 25 AS more FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) <= 25", key="preview_with_rest")(lambda t: W.preview_with_rest(t.orders.select("o_orderstatus", "o_orderkey"), ["o_orderstatus"], ["o_orderkey"], 25))
R.query("SELECT n_name AS name, n_nationkey AS id FROM nation UNION ALL SELECT r_name, NULL FROM region", key="union_frames")(lambda t: t.nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id")).unionByName(t.region.select(F.col("r_name").alias("name")), allowMissingColumns=True))
R.query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders", key="key_intersect")(lambda t: t.customer.select(F.col("c_custkey").alias("k")).intersect(t.orders.select("o_custkey")))
R.query("SELECT 'a' AS side, k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT s_suppkey FROM supplier) UNION ALL SELECT 'b', k FROM (SELECT s_suppkey AS k FROM supplier EXCEPT SELECT c_custkey FROM customer)", key="key_except")(lambda t: t.customer.select(F.col("c_custkey").alias("k")).subtract(t.supplier.select("s_suppkey")).select(F.lit("a").alias("side"), "k").unionByName(t.supplier.select(F.col("s_suppkey").alias("k")).subtract(t.customer.select("c_custkey")).select(F.lit("b").alias("side"), "k")))
R.query("SELECT event_type, count(DISTINCT user_id) AS total, count(DISTINCT CASE WHEN c_custkey IS NOT NULL THEN user_id END) AS known, count(DISTINCT CASE WHEN c_custkey IS NULL THEN user_id END) AS new, count_if(user_id IS NULL) AS no_id FROM events LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) ON user_id = c_custkey GROUP BY 1", key="overlap_summary")(lambda t: K.overlap_summary(t.events.select("event_type", "user_id"), t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id")), "event_type", "user_id"))

QUERIES, ORACLE = R.queries, R.oracle
