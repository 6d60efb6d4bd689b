"""Queries of the summaries: gated stages, class reports, binary tasks, agreement, progress, shapes, jitter and bands."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import metrics as K
from ..operators import summaries as Y
from ..operators import voxels as V
from .registry import Registry
from .reports import T, auc_sql, truth

R = Registry()

_CELLS = """cells AS (SELECT stage, truth, pred, count(*) AS n FROM x GROUP BY ALL),
roles AS (SELECT stage, truth AS class, n AS t, 0 AS p, CASE WHEN truth = pred THEN n ELSE 0 END AS tp FROM cells UNION ALL SELECT stage, pred, 0, n, 0 FROM cells),
per AS (SELECT w.stage, w.class, coalesce(sum(t), 0) AS t, coalesce(sum(p), 0) AS p, coalesce(sum(tp), 0) AS tp FROM wanted w LEFT JOIN roles r ON r.stage = w.stage AND r.class = w.class GROUP BY ALL),
pr AS (SELECT stage, class, t, p, tp, tp::DOUBLE / nullif(p, 0) AS precision, tp::DOUBLE / nullif(t, 0) AS recall FROM per),
f AS (SELECT *, CASE WHEN precision > 0 AND recall > 0 THEN 2 * precision * recall / (precision + recall) END AS f1 FROM pr)"""


def _stages_sql(parts: list[str], wanted: str, ovr: str) -> str:
    """``parts``: SELECTs of (stage, truth, pred, c); ``ovr``: a SELECT of (stage, class, s, y)."""
    return f"""{T}, x AS ({' UNION ALL '.join(parts)}), wanted(stage, class) AS (VALUES {wanted}), {_CELLS},
ok AS (SELECT stage, c, coalesce(truth = pred, false) AS y FROM x), o AS ({ovr}),
conf AS (SELECT stage, auc FROM {auc_sql('ok', 'y', 'c', 'stage')}), each AS (SELECT stage, class, auc FROM {auc_sql('o', 'y', 's', 'stage, class')}),
stages AS (SELECT DISTINCT stage FROM wanted)
SELECT stage, coalesce(n, 0) AS n, accuracy, macro_precision, macro_recall, macro_f1, conf.auc AS confidence_auc, macro_ovr_auc FROM stages
LEFT JOIN (SELECT stage, count(*) AS n, avg(coalesce(truth = pred, false)::INT::DOUBLE) AS accuracy FROM x GROUP BY 1) USING (stage)
LEFT JOIN (SELECT stage, avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1 FROM f GROUP BY 1) USING (stage)
LEFT JOIN conf USING (stage) LEFT JOIN (SELECT stage, avg(auc) AS macro_ovr_auc FROM each GROUP BY 1) USING (stage)"""


_P1 = "least(score / 5000, 1.0::DOUBLE)"
_QUALITY = "SELECT 'quality' AS stage, quality::VARCHAR AS truth, pred::VARCHAR AS pred, score AS c FROM truth"
_TOXIC = "SELECT 'toxic', toxic::VARCHAR, pred::VARCHAR, 1 / (1 + score) FROM truth WHERE quality = 1 AND pred = 1"
_BOTH = f"SELECT 'composite', quality || '_' || toxic, pred || '_' || (1 - pred), {_P1} / (1 + score) FROM truth WHERE quality || '_' || toxic IN ('0_0', '1_0', '1_1')"
_OVR = f"SELECT 'quality' AS stage, k AS class, CASE k WHEN '1' THEN {_P1} ELSE 1 - {_P1} END AS s, quality::VARCHAR = k AS y FROM truth, (VALUES ('0'), ('1')) v(k)"


def _quality_stage() -> Y.Stage:
    p1 = F.least(F.col("score") / 5000, F.lit(1.0))
    return Y.Stage("quality", F.col("quality"), F.col("pred"), F.col("score"), ["0", "1"], None, F.create_map(F.lit("0"), 1 - p1, F.lit("1"), p1))


@R.query(_stages_sql([_QUALITY], "('quality', '0'), ('quality', '1')", _OVR))
def evaluate_head(t):
    return Y.evaluate_stages(truth(t), [_quality_stage()])


@R.query(_stages_sql([_QUALITY, _TOXIC, _BOTH], "('quality', '0'), ('quality', '1'), ('toxic', '0'), ('toxic', '1'), ('composite', '0_0'), ('composite', '1_0'), ('composite', '1_1')", _OVR))
def cascade_report(t):
    """Two heads, the second on what the first lets through, and the composite label with the product of confidences."""
    label = F.concat_ws("_", "quality", "toxic")
    low = 1 / (1 + F.col("score"))
    toxic = Y.Stage("toxic", F.col("toxic"), F.col("pred"), low, ["0", "1"], F.expr("quality = 1 AND pred = 1"))
    both = Y.Stage("composite", label, F.concat_ws("_", "pred", 1 - F.col("pred")), F.least(F.col("score") / 5000, F.lit(1.0)) * low, ["0_0", "1_0", "1_1"], label.isin("0_0", "1_0", "1_1"))
    return Y.evaluate_stages(truth(t), [_quality_stage(), toxic, both])


_KINDS = ("click", "error", "view", "never")


@R.query("WITH p AS (SELECT event_type, k AS class, CASE WHEN k < event_type THEN value ELSE 100 - value / 2 END AS s FROM events, (VALUES " + ", ".join(f"('{k}')" for k in _KINDS) + ") v(k)), y AS (SELECT class, s, event_type = class AS y FROM p), a AS (SELECT class, auc FROM " + auc_sql("y", "y", "s", "class") + ") SELECT class, auc FROM a UNION ALL SELECT 'macro', avg(auc) FROM a")
def auc_ovr_macro(t):
    """From a map of probabilities; a class that never occurs has no AUC and is left out of the mean."""
    s = lambda k: F.when(F.lit(k) < F.col("event_type"), F.col("value")).otherwise(100 - F.col("value") / 2)
    probabilities = F.create_map(*[x for k in _KINDS for x in (F.lit(k), s(k))])
    return Y.ovr_auc(t.events.withColumn("p", probabilities), "event_type", "p", list(_KINDS))


@R.query("""WITH s AS (SELECT o_orderstatus AS truth, CASE WHEN o_totalprice > 150000 THEN 'F' WHEN o_totalprice > 90000 THEN 'O' ELSE 'X' END AS pred FROM orders), l(class) AS (VALUES ('F'), ('O'), ('P'), ('Q')),
k AS (SELECT * FROM s WHERE truth IN ('F', 'O', 'P', 'Q')),
g AS (SELECT class, count(*) FILTER (truth = class) AS n, count(*) FILTER (pred = class) AS predicted, count(*) FILTER (truth = class AND pred = class) AS tp, concat_ws(',', """ + ", ".join(f"count(*) FILTER (truth = class AND pred = '{c}')" for c in "FOPQ") + """) AS confusion FROM l, k GROUP BY 1)
SELECT class, n, predicted, tp::DOUBLE / nullif(n, 0) AS recall, tp::DOUBLE / nullif(predicted, 0) AS precision, confusion, NULL::DOUBLE AS accuracy, NULL::DOUBLE AS balanced, NULL::DOUBLE AS chance FROM g
UNION ALL SELECT 'ALL', sum(n)::BIGINT, sum(predicted)::BIGINT, NULL, NULL, NULL, sum(tp)::DOUBLE / sum(n), avg(tp::DOUBLE / nullif(n, 0)), 0.25 FROM g""")
def class_report(t):
    """Four labels, of which one never occurs and one is never predicted, and a prediction that is no label."""
    price = F.col("o_totalprice")
    rows = t.orders.withColumn("pred", F.when(price > 150000, "F").when(price > 90000, "O").otherwise("X"))
    return Y.class_report(rows, "o_orderstatus", "pred", ["F", "O", "P", "Q"])


_TASKS = {"fr+es vs de": (["fr", "es"], ["de"]), "en vs all": (["en"], ["fr", "es", "de"])}
_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)


@R.query(f"""WITH d AS (SELECT lang, n_chars::DOUBLE AS n_chars, (doc_id % 97)::DOUBLE AS mark FROM documents),
x AS ({' UNION ALL '.join(f"SELECT '{k}' AS task, lang IN ({_IN(p)}) AS y, n_chars, mark FROM d WHERE lang IN ({_IN(p + n)})" for k, (p, n) in _TASKS.items())}),
v AS (SELECT task, 'n_chars' AS score, y, n_chars AS s FROM x UNION ALL SELECT task, 'mark', y, mark FROM x),
a AS (SELECT task, score, auc, n_pos, n_neg FROM {auc_sql('v', 'y', 's', 'task, score')}),
h AS (SELECT task, score, s, count_if(y) AS p, count_if(NOT y) AS n FROM v GROUP BY ALL),
r AS (SELECT task, score, s, sum(p) OVER w / sum(p) OVER g AS tpr, sum(n) OVER w / sum(n) OVER g AS fpr FROM h WINDOW w AS (PARTITION BY task, score ORDER BY s DESC), g AS (PARTITION BY task, score)),
c AS (SELECT task, score, arg_max(s, (round(tpr - fpr, 12), s)) AS cutoff, 'youden' AS kind FROM r GROUP BY ALL UNION ALL SELECT DISTINCT task, score, k, 'fixed' FROM v, (VALUES ('n_chars', 500.0::DOUBLE), ('n_chars', 2000.0), ('mark', 48.0)) z(s2, k) WHERE score = s2),
m AS (SELECT task, score, cutoff, kind, coalesce(sum(p) FILTER (s >= cutoff), 0)::BIGINT AS tp, coalesce(sum(n) FILTER (s >= cutoff), 0)::BIGINT AS fp, coalesce(sum(p) FILTER (s < cutoff), 0)::BIGINT AS fn, coalesce(sum(n) FILTER (s < cutoff), 0)::BIGINT AS tn FROM h JOIN c USING (task, score) GROUP BY ALL)
SELECT *, tp::DOUBLE / nullif(tp + fn, 0) AS sensitivity, tn::DOUBLE / nullif(tn + fp, 0) AS specificity, tp::DOUBLE / nullif(tp + fp, 0) AS ppv, tn::DOUBLE / nullif(tn + fn, 0) AS npv, (tp + tn)::DOUBLE / nullif(tp + fp + fn + tn, 0) AS accuracy FROM m JOIN a USING (task, score)""")
def binary_tasks(t):
    rows = t.documents.select("lang", "n_chars", (F.col("doc_id") % 97).alias("mark"))
    return Y.binary_tasks(rows, "lang", ["n_chars", "mark"], _TASKS, {"n_chars": [500, 2000], "mark": [48]})


@R.query("""WITH m AS (SELECT o_orderpriority AS feature, o_clerk_group AS plane, CASE WHEN o_custkey % 7 > 0 THEN o_orderstatus END AS a, CASE WHEN o_totalprice > 150000 THEN 'F' ELSE 'O' END AS b, CASE WHEN o_orderkey % 5 > 0 THEN CASE WHEN o_totalprice > 100000 THEN 'F' ELSE 'O' END END AS t FROM (SELECT *, o_custkey % 3 AS o_clerk_group FROM orders))
SELECT 'overall' AS section, 'all' AS value, avg(coalesce(a = b, false)::INT::DOUBLE) AS share, count(*) AS n FROM m
UNION ALL SELECT 'feature', feature, avg(coalesce(a = b, false)::INT::DOUBLE), count(*) FROM m GROUP BY 2 UNION ALL SELECT 'plane', plane::VARCHAR, avg(coalesce(a = b, false)::INT::DOUBLE), count(*) FROM m GROUP BY 2
UNION ALL SELECT 'accuracy', 'a', avg((a = t)::INT::DOUBLE), count(*) FROM m WHERE a IS NOT NULL AND t IS NOT NULL UNION ALL SELECT 'accuracy', 'b', avg((b = t)::INT::DOUBLE), count(*) FROM m WHERE t IS NOT NULL""")
def agreement_by_facet(t):
    big = lambda x: F.when(F.col("o_totalprice") > x, "F").otherwise("O")
    rows = t.orders.select(F.col("o_orderpriority").alias("feature"), (F.col("o_custkey") % 3).alias("plane"), F.when(F.col("o_custkey") % 7 > 0, F.col("o_orderstatus")).alias("a"), big(150000).alias("b"), F.when(F.col("o_orderkey") % 5 > 0, big(100000)).alias("t"))
    return Y.agreement_report(rows, "a", "b", ["feature", "plane"], {"a": "t", "b": "t"})


@R.query("""WITH k AS (SELECT o_custkey, CASE o_orderstatus WHEN 'O' THEN 'excluded' WHEN 'F' THEN CASE WHEN o_orderpriority < '3' THEN 'both' ELSE 'only_segmented' END END AS k FROM orders),
g AS (SELECT o_custkey, count_if(k = 'both') AS "both", count_if(k = 'only_segmented') AS only_segmented, count_if(k = 'excluded') AS excluded FROM k WHERE k IS NOT NULL GROUP BY 1)
SELECT *, CASE WHEN "both" > 0 THEN 'both' WHEN only_segmented > 0 THEN 'only_segmented' ELSE 'excluded' END AS best, excluded > 0 AND "both" + only_segmented > 0 AS mixed FROM g""")
def status_rollup(t):
    state = F.when(F.col("o_orderstatus") == "F", " Done").when(F.col("o_orderstatus") == "O", "exclude")
    return Y.category_rollup(t.orders, "o_custkey", state, F.when(F.col("o_orderpriority") < "3", F.col("o_orderpriority")).otherwise(" "))


@R.query(" UNION ALL ".join(f"SELECT '{c}' AS by, {c}::VARCHAR AS value, count(*) AS total, count_if(coalesce(value > 50, false)) AS reviewed, count_if(NOT coalesce(value > 50, false)) AS remaining FROM events GROUP BY 2" for c in ("event_type", "user_id")))
def review_progress(t):
    """By predicted class and by subject."""
    return Y.review_progress(t.events, ["event_type", "user_id"], F.col("value") > 50)


_SHAPE = "CASE p_partkey % 7 WHEN 0 THEN [p_size, p_size] WHEN 1 THEN [p_size, p_size, 3, p_size % 4] WHEN 2 THEN NULL ELSE [p_size, p_size, 9] END"


@R.query(f"""WITH s AS (SELECT {_SHAPE} AS shape, CASE WHEN p_partkey % 35 = 9 THEN 'bad magic' END AS error FROM part), n AS (SELECT *, len(shape) AS nd, error IS NOT NULL OR shape IS NULL AS bad FROM s)
SELECT 'note' AS kind, CASE WHEN bad THEN 'ERROR' WHEN nd = 3 THEN 'ok' WHEN nd = 4 THEN '4D-multivolume' ELSE 'UNEXPECTED-NDIM' END AS value, count(*) AS n FROM n GROUP BY 2
UNION ALL SELECT 'ndim', nd::VARCHAR, count(*) FROM n WHERE NOT bad GROUP BY 2 UNION ALL SELECT 'axis4', shape[4]::VARCHAR, count(*) FROM n WHERE NOT bad AND nd = 4 GROUP BY 2
UNION ALL SELECT 'error', coalesce(error, 'no shape'), count(*) FROM n WHERE bad GROUP BY 2""")
def shape_report(t):
    shape = F.expr("CASE p_partkey % 7 WHEN 0 THEN array(p_size, p_size) WHEN 1 THEN array(p_size, p_size, 3, p_size % 4) WHEN 2 THEN NULL ELSE array(p_size, p_size, 9) END")
    return Y.shape_report(t.part.select(shape.alias("shape"), F.when(F.col("p_partkey") % 35 == 9, "bad magic").alias("error")), "shape", "error")


@R.query(f"{T} SELECT source, " + ", ".join(f"avg(score) FILTER (lang = '{c}') AS {c}" for c in ("en", "de", "fr", "es")) + " FROM truth GROUP BY 1")
def pivot_mean(t):
    return Y.pivot_mean(truth(t), "source", "lang", "score", ["en", "de", "fr", "es"])


@R.query("SELECT event_type, count(*) AS n, avg(value) AS mean, median(value) AS median, stddev_samp(value) AS std, avg(value / (1 + user_id % 4)) AS ratio_mean, median(value / (1 + user_id % 4)) AS ratio_median FROM events GROUP BY 1")
def metric_by_group(t):
    return K.metric_by_group(t.events.withColumn("ratio", F.col("value") / (1 + F.col("user_id") % 4)), ["event_type"], "value", "ratio")


@R.query("SELECT event_type, count(*) AS n, median(value) AS median, min(value) AS min, max(value) AS max, arg_min(user_id % 3, event_id) AS category, median(user_id) AS score_median FROM events GROUP BY 1")
def group_stats(t):
    return K.group_stats(t.events.withColumn("c", F.col("user_id") % 3), ["event_type"], "value", "c", "event_id", "user_id")


@R.query("WITH p AS (SELECT page_id, page_id % 10 AS run, page_id % 2 = 0 AS has FROM pages) SELECT page_id, run, CASE WHEN has THEN page_id || '_overlay.png' ELSE page_id || '.png' END AS path, has AS has_contour, bool_and(has) OVER (PARTITION BY run) AS run_has_contour FROM p")
def overlay_or_plain(t):
    """With the flag of each run: runs of even pages have it."""
    have = t.pages.where("page_id % 2 = 0").selectExpr("concat(page_id, '_overlay.png') AS path")
    return J.overlay_or_plain(t.pages.selectExpr("page_id", "page_id % 10 AS run", "concat(page_id, '.png') AS path"), have, "path", F.regexp_replace("path", r"\.png$", "_overlay.png"), ["run"])


_U = lambda k: f"(('0x' || substr(md5('3:{k}:' || p_partkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _jitter(axis: str, extent: int, k: int) -> str:
    lo, hi = f"{axis}0", f"{axis}1"
    middle = f"({lo} + ({hi} - {lo} + 1)::DOUBLE / 2 + ((2.0::DOUBLE * {_U(k)} - 1) * 0.25::DOUBLE) * ({hi} - {lo} + 1))"
    half = f"(({hi} - {lo} + 1)::DOUBLE * (0.5::DOUBLE + (1.5::DOUBLE - 0.5::DOUBLE) * {_U(2 + k)}) / 2)"
    return f"round_even(greatest(0.0::DOUBLE, {middle} - {half}), 0)::INT AS {axis}a, round_even(least({extent - 1}.0::DOUBLE, {middle} + {half}), 0)::INT AS {axis}b"


def _never_flat(axis: str, extent: int) -> str:
    a, b = f"{axis}a", f"{axis}b"
    return f"CASE WHEN {b} <= {a} THEN greatest(0, least({a}, {extent - 2})) ELSE {a} END AS {axis}0, CASE WHEN {b} <= {a} THEN least({extent - 1}, greatest({a} + 1, {b})) ELSE {b} END AS {axis}1"


@R.query(f"WITH b AS (SELECT p_partkey, p_size * 2 AS x0, p_size * 2 + p_partkey % 9 AS x1, 79 - p_size AS y0, least(79, 79 - p_size + p_partkey % 5) AS y1 FROM part), j AS (SELECT p_partkey, {_jitter('x', 100, 0)}, {_jitter('y', 80, 1)} FROM b) SELECT p_partkey, {_never_flat('x', 100)}, {_never_flat('y', 80)} FROM j")
def box_jitter(t):
    """Boxes up to and beyond the image's borders, down to one pixel."""
    boxes = t.part.selectExpr("p_partkey", "p_size * 2 AS x0", "p_size * 2 + p_partkey % 9 AS x1", "79 - p_size AS y0", "least(79, 79 - p_size + p_partkey % 5) AS y1").select("p_partkey", *[F.col(c).cast("int").alias(c) for c in ("x0", "x1", "y0", "y1")])
    return V.jitter_box(boxes, "p_partkey", F.lit(100), F.lit(80), 0.25, (0.5, 1.5), 3)


_WAVE = "SELECT vec_id, k, pow(2.0::DOUBLE / 64, 2) * (pow(sum(v * cos(k * i * {w}::DOUBLE)), 2) + pow(sum(v * sin(k * i * {w}::DOUBLE)), 2)) AS a2 FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), range(3, 23) r(k) WHERE k BETWEEN 3 AND 7 OR k BETWEEN 8 AND 22 GROUP BY ALL".format(w=2 * math.pi / 64)


@R.query(f"WITH a AS ({_WAVE}) SELECT vec_id, sqrt(sum(a2) FILTER (k <= 7)) AS lobe_amp, sqrt(sum(a2) FILTER (k >= 8)) AS jag_amp FROM a GROUP BY 1")
def harmonic_bands(t):
    profile = t.embeddings.select("vec_id", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    return V.harmonic_bands(profile, ["vec_id"], "i", "v", 64)


@R.query()
def subjects_by_sketch(t):
    """Distinct users of each event type over all days, from one sketch per day; an estimate, so tests hold its error bound."""
    days = K.subject_sketches(t.events.withColumn("day", F.to_date("ts")), ["event_type", "day"], "user_id")
    return K.estimated_subjects(K.merge_sketches(days, ["event_type"]))


QUERIES, ORACLE = R.queries, R.oracle
