"""Queries of counts, confusion, agreement, ROC, votes and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as K
from .registry import Registry, Tables
from .tables import S, status

R = Registry()
_ERR = "event_type = 'error'"


def truth(t: Tables) -> DataFrame:
    """Labelled documents with a rule's prediction and a score."""
    d = t.documents.select("doc_id", "source", "lang", "n_chars")
    return t.labels.join(d, "doc_id").withColumns({"pred": (F.col("n_chars") > 800).cast("int"), "score": F.col("n_chars").cast("double")})


T = "WITH truth AS (SELECT doc_id, source, lang, n_chars, quality, toxic, (n_chars > 800)::INT AS pred, n_chars::DOUBLE AS score FROM labels JOIN documents USING (doc_id))"


@R.query(f"{S} SELECT CASE WHEN grouping(a) = 1 THEN 'TOTAL' ELSE a END AS a, CASE WHEN grouping(b) = 1 THEN 'TOTAL' ELSE b END AS b, count(*) AS n FROM status GROUP BY CUBE (a, b)")
def crosstab_margins(t):
    return K.crosstab_margins(status(t), "a", "b")


_CLS = "(VALUES ('F'), ('O'), ('P'))"
_CONF = f"cells AS (SELECT coalesce(g.truth, s.truth) AS truth, coalesce(g.pred, s.pred) AS pred, coalesce(n, 0) AS n FROM (SELECT x.c AS truth, y.c AS pred FROM {_CLS} x(c), {_CLS} y(c)) g FULL JOIN (SELECT b AS truth, a AS pred, count(*) AS n FROM status GROUP BY 1, 2) s ON g.truth = s.truth AND g.pred = s.pred)"
R.query(f"{S}, {_CONF} SELECT truth, pred, n FROM cells", key="confusion_table")(lambda t: K.confusion_table(status(t), "b", "a", ["F", "O", "P"]))
R.query(f"{S}, {_CONF} SELECT truth, pred, n, n * 100.0::DOUBLE / nullif(sum(n) OVER (PARTITION BY truth), 0) AS pct FROM cells", key="confusion_pct")(lambda t: K.confusion_pct(K.confusion_table(status(t), "b", "a", ["F", "O", "P"])))
_PC = """r AS (SELECT b AS class, 1 AS t, (a = b)::INT AS p FROM status UNION ALL SELECT a, 0, 1 FROM status),
g AS (SELECT class, sum(t) AS support, sum(t * p) AS tp, sum((1 - t) * p) AS np FROM r GROUP BY 1),
m AS (SELECT class, support::BIGINT AS support, tp::BIGINT AS tp, (np - tp)::BIGINT AS fp, (support - tp)::BIGINT AS fn, tp::DOUBLE / nullif(np, 0) AS precision, tp::DOUBLE / nullif(support, 0) AS recall FROM g),
pc AS (SELECT *, CASE WHEN precision > 0 AND recall > 0 THEN 2 * precision * recall / (precision + recall) END AS f1 FROM m)"""
R.query(f"{S}, {_PC} SELECT * FROM pc", key="per_class_metrics")(lambda t: K.per_class_metrics(status(t), "b", "a"))
R.query(f"{S}, {_PC} SELECT avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1 FROM pc", key="macro_metrics")(lambda t: K.macro_metrics(K.per_class_metrics(status(t), "b", "a")))
R.query(f"{S} SELECT count(*) AS n, avg((a = b)::INT::DOUBLE) AS accuracy FROM status", key="overall_accuracy")(lambda t: K.overall_accuracy(status(t), "b", "a"))


def auc_sql(table: str, positive: str, score: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    cols = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""(SELECT {cols}sum(w) / nullif(sum(p)::DOUBLE * sum(n), 0) AS auc, sum(p)::BIGINT AS n_pos, sum(n)::BIGINT AS n_neg FROM (SELECT {cols}s, p, n, p * (coalesce(sum(n) OVER ({part} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2.0::DOUBLE) AS w FROM (SELECT {cols}{score} AS s, count_if({positive}) AS p, count_if(NOT ({positive})) AS n FROM {table} WHERE {score} IS NOT NULL GROUP BY ALL)) {group})"""


R.query(f"SELECT * FROM {auc_sql('events', _ERR, 'value')}", key="auc_rank")(lambda t: K.auc_rank(t.events, F.expr(_ERR), "value"))
R.query(f"{T} SELECT lang, auc, n_pos, n_neg FROM {auc_sql('truth', 'pred = quality', 'score', 'lang')}", key="auc_confidence")(lambda t: K.auc_rank(truth(t), F.col("pred") == F.col("quality"), "score", ["lang"]))
R.query(f"{T}, z AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (score / 5000) * (1 - toxic * 0.5::DOUBLE))) AS z FROM truth) SELECT auc FROM {auc_sql('z', 'quality = 1', 'z')}", key="auc_composite")(lambda t: K.auc_rank(truth(t).withColumn("z", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score") / 5000 * (1 - F.col("toxic") * 0.5)))), F.col("quality") == 1, "z").select("auc"))
_ROC = f"roc AS (SELECT threshold, sum(p) OVER (ORDER BY threshold DESC)::DOUBLE / sum(p) OVER () AS tpr, sum(n) OVER (ORDER BY threshold DESC)::DOUBLE / sum(n) OVER () AS fpr FROM (SELECT value AS threshold, count_if({_ERR}) AS p, count_if(NOT {_ERR}) AS n FROM events GROUP BY 1))"
R.query(f"WITH {_ROC} SELECT threshold, tpr, fpr FROM roc", key="roc_curve")(lambda t: K.roc_curve(t.events, F.expr(_ERR), "value"))
R.query(f"WITH {_ROC} SELECT arg_max(threshold, (round(tpr - fpr, 12), threshold)) AS cutoff, round(max(tpr - fpr), 12) AS youden FROM roc", key="youden_cutoff")(lambda t: K.youden_cutoff(K.roc_curve(t.events, F.expr(_ERR), "value")))
_CUT = "SELECT {by}c AS cutoff, count_if({y} AND {s} >= c) AS tp, count_if(NOT {y} AND {s} >= c) AS fp, count_if({y} AND {s} < c) AS fn, count_if(NOT {y} AND {s} < c) AS tn FROM {t}, (VALUES (20.0::DOUBLE), (50.0), (80.0)) v(c) GROUP BY ALL"
_RATES = "tp::DOUBLE / nullif(tp + fn, 0) AS sensitivity, tn::DOUBLE / nullif(tn + fp, 0) AS specificity, tp::DOUBLE / nullif(tp + fp, 0) AS precision, tn::DOUBLE / nullif(tn + fn, 0) AS npv, 2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0) AS f1, (tp + tn)::DOUBLE / (tp + fp + fn + tn) AS accuracy"
R.query(f"SELECT *, {_RATES} FROM ({_CUT.format(by='', y=f'({_ERR})', s='value', t='events')})", key="cutoff_metrics")(lambda t: K.cutoff_metrics(t.events, F.expr(_ERR), "value", [20, 50, 80]))
R.query(f"{T} SELECT *, {_RATES} FROM ({_CUT.format(by='', y='(quality = 1)', s='score', t='truth')}) WHERE cutoff = 50", key="threshold_accuracy")(lambda t: K.cutoff_metrics(truth(t), F.col("quality") == 1, "score", [50]))
R.query(f"{S}, x AS (SELECT c AS class, coalesce(a = c, false) AS pa, coalesce(b = c, false) AS pb FROM status, {_CLS} v(c)), g AS (SELECT class, count_if(pa AND pb) AS tp, count_if(NOT pa AND NOT pb) AS tn, count_if(pa AND NOT pb) AS fp, count_if(NOT pa AND pb) AS fn FROM x GROUP BY 1), m AS (SELECT *, (tp + tn)::DOUBLE / (tp + tn + fp + fn) AS agreement, tp::DOUBLE / nullif(tp + fp, 0) AS precision, tp::DOUBLE / nullif(tp + fn, 0) AS recall FROM g) SELECT *, 2 * precision * recall / nullif(precision + recall, 0) AS f1 FROM m", key="binary_agreement")(lambda t: K.binary_agreement(status(t), "a", "b", ["F", "O", "P"]))
R.query(f"{S} SELECT o_orderkey, c AS class, a, b FROM status, {_CLS} v(c) WHERE coalesce(a = c, false) <> coalesce(b = c, false)", key="disagreement_rows")(lambda t: K.disagreement_rows(status(t).drop("o_custkey"), "a", "b", ["F", "O", "P"]))
R.query(f"{T} SELECT doc_id, pred <> quality AS quality_wrong, pred <> toxic AS toxic_wrong FROM truth WHERE pred <> quality OR pred <> toxic", key="misclassified_rows")(lambda t: K.misclassified_rows(truth(t), {"quality": ("quality", "pred"), "toxic": ("toxic", "pred")}).select("doc_id", "quality_wrong", "toxic_wrong"))
R.query(f"{S}, n AS (SELECT count(*)::DOUBLE AS n, count_if(a = b)::DOUBLE AS same FROM status), e AS (SELECT sum(coalesce(x, 0)::DOUBLE * coalesce(y, 0)) AS s, count(*) AS k FROM (SELECT a AS l, count(*) AS x FROM status GROUP BY 1) p FULL JOIN (SELECT b AS l, count(*) AS y FROM status GROUP BY 1) q USING (l)) SELECT CASE WHEN n > 1 AND k > 1 THEN (same / n - s / (n * n)) / nullif(1 - s / (n * n), 0) END AS kappa, same / n AS observed, s / (n * n) AS expected FROM n, e", key="cohen_kappa")(lambda t: K.cohen_kappa(status(t), "a", "b"))
_FACET = "SELECT '{f}' AS facet, coalesce({f}::VARCHAR, '?') AS value, count_if(pred = quality) AS correct, count(quality) AS scored, count_if(pred = quality)::DOUBLE / nullif(count(quality), 0) AS accuracy FROM truth GROUP BY 2"
R.query(f"{T} " + " UNION ALL ".join(_FACET.format(f=f) for f in ("lang", "source", "toxic")), key="accuracy_by_facets")(lambda t: K.facet_accuracy(truth(t).withColumn("ok", F.col("pred") == F.col("quality")), "ok", ["lang", "source", "toxic"]))
R.query(f"{S} SELECT a AS source, b AS target, count(*) AS n, a <> b AS changed FROM status GROUP BY ALL", key="transition_counts")(lambda t: K.transition_counts(status(t), "a", "b"))
R.query(f"{S}, n AS (SELECT a AS source, b AS target, count(*) AS n FROM status GROUP BY ALL) SELECT source, target, n, (dense_rank() OVER (ORDER BY source) - 1)::INT AS source_index, dense_rank() OVER (ORDER BY target) - 1 + (SELECT count(DISTINCT source) FROM n) AS target_index FROM n", key="flow_nodes_links")(lambda t: K.flow_nodes_links(status(t), "a", "b"))
_VOTE = "v AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS pos FROM events WHERE event_type <> 'error' GROUP BY ALL), vote AS (SELECT user_id, arg_max(event_type, (n, -pos)) AS vote FROM v GROUP BY 1)"
R.query(f"WITH {_VOTE} SELECT user_id, coalesce(vote, 'error') AS vote FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN vote USING (user_id)", key="majority_vote")(lambda t: K.majority_vote(t.events, ["user_id"], "event_type", "event_id", "error"))
R.query("WITH v AS (SELECT conv_id, role, count(*) AS n, min(turn) AS pos FROM conversations GROUP BY ALL), vote AS (SELECT conv_id, arg_max(role, (n, -pos)) AS vote FROM v GROUP BY 1) SELECT conv_id, count(*) AS n_items, count_if(role = 'user') AS n_correct, string_agg(role, ';' ORDER BY turn, role) AS labels, any_value(vote) AS vote FROM conversations JOIN vote USING (conv_id) GROUP BY 1", key="aggregate_votes")(lambda t: K.aggregate_votes(t.conversations.withColumn("truth", F.lit("user")), ["conv_id"], "role", "turn", "truth"))
R.query("SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) ELSE 'uncertain' END AS label FROM orders GROUP BY 1", key="unanimous_label")(lambda t: K.unanimous_label(t.orders, "o_custkey", "o_orderstatus"))
R.query("SELECT o_custkey, coalesce(arg_min(o_orderstatus, o_orderkey) FILTER (o_orderstatus <> 'P'), 'unknown') AS truth FROM orders GROUP BY 1", key="known_truth")(lambda t: K.known_truth(t.orders.withColumn("s", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).otherwise("")), ["o_custkey"], "s", "o_orderkey"))
R.query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1", key="distinct_join")(lambda t: t.orders.groupBy("o_custkey").agg(K.distinct_join("o_orderpriority").alias("priorities")))
R.query("SELECT event_type AS value, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS pct FROM events GROUP BY 1", key="value_counts_pct")(lambda t: K.value_counts_pct(t.events, "event_type"))
R.query("SELECT pred AS value, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS pct FROM (SELECT (n_chars > 800)::INT AS pred FROM documents) GROUP BY 1", key="prediction_distribution")(lambda t: K.value_counts_pct(t.documents.select((F.col("n_chars") > 800).cast("int").alias("pred")), "pred"))
R.query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS subjects FROM events GROUP BY 1", key="count_with_subjects")(lambda t: K.count_with_subjects(t.events, "event_type", "user_id"))
R.query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1", key="job_status_counts")(lambda t: t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n")))
R.query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY n DESC, l_returnflag", key="availability_counts")(lambda t: t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_returnflag"))
R.query("SELECT event_type, min(value) AS low, quantile_cont(value, 0.25) AS q1, median(value) AS median, quantile_cont(value, 0.75) AS q3, max(value) AS high FROM events GROUP BY 1", key="five_number_summary")(lambda t: K.five_number_summary(t.events, ["event_type"], "value"))
R.query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", min({c})::DOUBLE AS min, quantile_cont({c}::DOUBLE, 0.05) AS p05, median({c}::DOUBLE) AS median, avg({c}::DOUBLE) AS mean, quantile_cont({c}::DOUBLE, 0.95) AS p95, max({c})::DOUBLE AS max FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_tax")), key="distribution_profile")(lambda t: K.distribution_profile(t.lineitem, ["l_quantity", "l_extendedprice", "l_tax"]))
R.query("WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT least(floor((o_totalprice - lo) / (hi - lo) * 30), 29)::INT AS bin, count(*) AS n FROM orders, e GROUP BY 1", key="histogram_bins")(lambda t: K.histogram_bins(t.orders, "o_totalprice"))
R.query("WITH g AS (SELECT p_type, p_brand, count(*) AS n, avg(p_retailprice) AS mean, stddev_samp(p_retailprice) AS std, grouping(p_brand) AS t FROM part GROUP BY GROUPING SETS ((p_type, p_brand), (p_type))) SELECT p_type, CASE WHEN t = 1 THEN 'Total' ELSE p_brand END AS p_brand, n, round(n * 100.0::DOUBLE / sum(CASE WHEN t = 0 THEN n END) OVER (PARTITION BY p_type), 2) AS pct, mean, std FROM g", key="subtotal_table")(lambda t: K.subtotal_table(t.part, "p_type", "p_brand", "p_retailprice"))
R.query("WITH n AS (SELECT o_custkey, o_orderpriority AS v, count(*) AS n FROM orders GROUP BY ALL) SELECT o_custkey, v AS top, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY o_custkey), 2) AS pct FROM n QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, v) = 1", key="top_value_share")(lambda t: K.top_value_share(t.orders, ["o_custkey"], "o_orderpriority"))
R.query("WITH n AS (SELECT user_id, event_type AS l, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, l) AS rn FROM n) SELECT user_id, " + ", ".join(f"coalesce(max(CASE WHEN rn = {i} THEN l END), '') AS label_{i}, coalesce(max(CASE WHEN rn = {i} THEN n END), 0) AS count_{i}" for i in (1, 2, 3)) + ", sum(n)::BIGINT AS instances, count(*) AS unique_labels FROM r GROUP BY 1", key="topk_wide")(lambda t: K.topk_wide(t.events, ["user_id"], "event_type"))
R.query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3", key="global_top_labels")(lambda t: t.events.groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(3))
R.query(" UNION ALL ".join(f"SELECT '{c}' AS field, count_if(trim(coalesce({c}::VARCHAR, '')) <> '') AS filled FROM documents" for c in ("text", "lang", "source")), key="field_fill_counts")(lambda t: K.field_fill_counts(t.documents, ["text", "lang", "source"]))
R.query("SELECT p_brand, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN p_brand ELSE 'Others' END AS folded, count(*) AS n FROM part GROUP BY ALL", key="collapse_others")(lambda t: t.part.groupBy("p_brand", F.when(F.col("p_brand").isin("Brand#1", "Brand#2"), F.col("p_brand")).otherwise("Others").alias("folded")).agg(F.count("*").alias("n")))
R.query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, min(o_orderdate)::DATE AS day FROM orders GROUP BY 1", key="first_row_attributes")(lambda t: t.orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"), F.min("o_orderdate").cast("date").alias("day")))
R.query("SELECT string_agg(DISTINCT lang, ';' ORDER BY lang) AS langs, count(DISTINCT source) AS sources, count(*) AS rows FROM documents", key="config_consistency")(lambda t: t.documents.agg(K.distinct_join("lang").alias("langs"), F.count_distinct("source").alias("sources"), F.count("*").alias("rows")))
R.query(f"{S} SELECT a AS old, b AS new, count(*) AS n FROM status WHERE a <> b GROUP BY ALL", key="reparse_diff")(lambda t: status(t).where("a <> b").groupBy(F.col("a").alias("old"), F.col("b").alias("new")).agg(F.count("*").alias("n")))
R.query(f"{T}, r AS (SELECT lang, quality AS class, 1 AS t, (pred = quality)::INT AS p FROM truth) SELECT lang, avg(rc) AS balanced FROM (SELECT lang, class, avg(p) AS rc FROM r GROUP BY 1, 2) GROUP BY 1", key="balanced_accuracy_by_level")(lambda t: K.per_class_metrics(truth(t), "quality", "pred", ["lang"]).where("support > 0").groupBy("lang").agg(F.avg("recall").alias("balanced")))

QUERIES, ORACLE = R.queries, R.oracle
