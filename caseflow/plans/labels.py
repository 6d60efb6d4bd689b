"""Queries of label rules, codings, and text, path, date, map and reply expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import maps as M
from ..functions import reply as P
from ..functions import text as X
from .registry import Registry, Tables

R = Registry()

#: Scan headers derived from parts; the same expressions serve Spark and DuckDB.
HEADERS = [
    "p_partkey AS scan",
    "CASE p_partkey % 12 WHEN 0 THEN 'SAG T1 FSE' WHEN 1 THEN 'AX STIR' WHEN 2 THEN 'AX GRE T2' WHEN 3 THEN 'COR PD' WHEN 4 THEN 'AX T1 +C' WHEN 5 THEN 'DWI b800' WHEN 6 THEN 'SCOUT' WHEN 7 THEN 'T2 FAT_SAT' WHEN 8 THEN 'MERGE GD' WHEN 9 THEN 'AX LAVA' WHEN 10 THEN 'PDW FS' ELSE p_name END AS description",
    "CASE WHEN p_partkey % 5 = 0 THEN 'GRE' WHEN p_partkey % 7 = 0 THEN 'SE FS' ELSE '' END AS options",
    "CASE WHEN p_partkey % 17 = 0 THEN 'x' ELSE CAST(p_size * 80 AS STRING) END AS tr",
    "CAST(p_partkey % 90 AS STRING) AS te",
    "CASE WHEN p_partkey % 6 = 0 THEN CAST(p_size * 55 AS STRING) ELSE '' END AS ti",
    "CASE WHEN p_partkey % 4 = 0 THEN '8' ELSE '1' END AS etl",
    "CAST(p_size * 2 AS STRING) AS flip",
    "CASE WHEN p_partkey % 3 = 0 THEN '1.5' WHEN p_partkey % 3 = 1 THEN '3' ELSE '' END AS field",
    "CASE WHEN p_partkey % 8 = 1 THEN 'GR' ELSE 'SE' END AS scanning",
    "CASE WHEN p_partkey % 9 = 0 THEN 'Dotarem' WHEN p_partkey % 9 = 1 THEN 'NONE' ELSE '' END AS agent",
    "CASE WHEN p_partkey % 10 = 0 THEN '0' WHEN p_partkey % 10 = 1 THEN '' ELSE '7' END AS dose",
    "CASE WHEN p_partkey % 31 = 0 THEN 'ORIGINAL DIFFUSION' ELSE 'ORIGINAL' END AS image_type",
    "CASE WHEN p_partkey % 29 = 0 THEN '800' WHEN p_partkey % 29 = 1 THEN '0' ELSE '' END AS b_value",
    "p_brand AS brand", "p_type AS type",
]
H = "WITH headers AS (SELECT " + ", ".join(HEADERS) + " FROM part)"
_TOK = "list_filter(regexp_split_to_array(upper({}), '[^A-Z]+'), lambda x: x <> '')"
_HAS = "list_has_any({}, {})"


def _words(c: str, words) -> str:
    return _HAS.format(_TOK.format(c), "[" + ", ".join(f"'{w}'" for w in words) + "]")


_GRE = f"({_words(chr(40) + 'description || chr(32) || options' + chr(41), L.GRE_WORDS)} AND NOT {_words(chr(40) + 'description || chr(32) || options' + chr(41), L.SE_WORDS)})"


def headers(t: Tables) -> DataFrame:
    return t.part.selectExpr(*HEADERS)


_KEYWORD = f"""CASE WHEN regexp_matches(upper(description), 'CAL|LOC|SCOUT|SURVEY') THEN 'localizer'
 WHEN regexp_matches(upper(description), 'DWI|DIF|ADC') THEN 'DWI' WHEN contains(upper(description), 'PERFUSION') THEN 'perfusion'
 WHEN regexp_matches(upper(description), '\\b(LAVA|FAME)\\b') THEN 'T1W' WHEN {_words('description', ['STIR'])} THEN 'T2W'
 WHEN contains(upper(description), 'T1') THEN 'T1W' WHEN regexp_matches(upper(description), 'T2\\*|\\bMERGE\\b') THEN 'T2*'
 WHEN contains(upper(description), 'T2') OR contains(upper(description), 'STIR') THEN CASE WHEN {_GRE} THEN 'T2*' ELSE 'T2W' END
 WHEN {_words('description', ['PDW', 'DP', 'PD'])} THEN 'PD' ELSE '' END"""


@R.query(f"{H} SELECT scan, array_to_string({_TOK.format('description')}, ' ') AS tokens FROM headers")
def alpha_tokens(t):
    return headers(t).select("scan", F.array_join(X.alpha_tokens("description"), " ").alias("tokens"))


@R.query(f"{H} SELECT scan, {_GRE} AS gre FROM headers")
def tokens_any(t):
    return headers(t).select("scan", L.gre_flag("description", "options").alias("gre"))


@R.query(f"{H} SELECT scan, {_KEYWORD} AS label FROM headers")
def keyword_label(t):
    return headers(t).select("scan", L.keyword_label("description", "options").alias("label"))


_TR, _TE = "TRY_CAST(tr AS DOUBLE)", "TRY_CAST(te AS DOUBLE)"
_THRESHOLD = f"""CASE WHEN {_TR} IS NULL OR {_TE} IS NULL THEN '' WHEN {_GRE} THEN CASE WHEN {_TE} < 10 THEN CASE WHEN {_TR} < 600 THEN 'T1W' ELSE 'PD' END WHEN {_TE} > 15 THEN CASE WHEN {_TR} > 1000 THEN 'T2*' ELSE 'mixed' END ELSE 'PD' END
 ELSE CASE WHEN {_TE} < 25 AND {_TR} < 600 THEN 'T1W' WHEN {_TE} < 25 AND {_TR} > 1500 THEN 'PD' WHEN {_TE} > 60 AND {_TR} > 1500 THEN 'T2W' ELSE '' END END"""
_RELABEL = f"""CASE WHEN k = 'PD' AND {_TR} IS NOT NULL AND {_TE} IS NOT NULL THEN CASE WHEN {_TE} < 10 THEN CASE WHEN {_TR} < 600 THEN 'T1W' ELSE 'PD' END WHEN {_TE} > 15 THEN CASE WHEN {_TR} <= 1000 THEN 'mixed' WHEN {_GRE} THEN 'T2*' ELSE 'T2W' END ELSE 'PD' END ELSE k END"""
_FATSAT = f"CASE WHEN {_words('(description || chr(32) || options)', L.FATSAT_WORDS)} OR contains(upper(description), 'STIR') THEN 'fatsat' ELSE '' END"
_NAMED = f"({_words('description', ['GD', 'GAD'])} OR regexp_matches(upper(description), '\\+C|\\bCTE\\b'))"
_CONTRAST = f"CASE WHEN {_NAMED} OR (trim(agent) <> '' AND trim(dose) NOT IN ('', '0')) OR ({_words('agent', L.AGENT_WORDS)} AND dose <> '0') THEN 'contrast' ELSE '' END"


@R.query(f"{H} SELECT scan, {_THRESHOLD} AS label FROM headers")
def threshold_label(t):
    h = headers(t).withColumn("gre", L.gre_flag("description", "options"))
    return h.select("scan", L.threshold_label(X.to_number("tr"), X.to_number("te"), "gre").alias("label"))


@R.query(f"{H}, k AS (SELECT *, {_KEYWORD} AS k FROM headers) SELECT scan, {_RELABEL} AS label FROM k")
def threshold_relabel(t):
    h = headers(t).withColumns({"k": L.keyword_label("description", "options"), "gre": L.gre_flag("description", "options")})
    return h.select("scan", L.threshold_relabel("k", "tr", "te", "gre").alias("label"))


@R.query(f"{H} SELECT scan, {_FATSAT} AS fat_sat FROM headers")
def fatsat_flag(t):
    return headers(t).select("scan", L.fatsat_flag("description", "options").alias("fat_sat"))


@R.query(f"{H} SELECT scan, {_CONTRAST} AS contrast FROM headers")
def contrast_flag(t):
    return headers(t).select("scan", L.contrast_flag("description", "agent", "dose").alias("contrast"))


@R.query(f"""{H}, k AS (SELECT *, {_KEYWORD} AS k FROM headers WHERE trim(tr) <> '' AND trim(te) <> '' AND trim(field) <> ''),
r AS (SELECT *, {_RELABEL} AS r FROM k)
SELECT label, fat_sat, contrast, count(*) AS n FROM (SELECT CASE WHEN r = '' THEN {_THRESHOLD} ELSE r END AS label, {_FATSAT} AS fat_sat, {_CONTRAST} AS contrast FROM r) GROUP BY ALL""")
def keyword_pipeline(t):
    from ..operators.rows import required_nonblank

    h = required_nonblank(headers(t), ["tr", "te", "field"]).withColumn("gre", L.gre_flag("description", "options"))
    h = h.withColumn("k", L.keyword_label("description", "options")).withColumn("r", L.threshold_relabel("k", "tr", "te", "gre"))
    label = F.when(F.col("r") == "", L.threshold_label(X.to_number("tr"), X.to_number("te"), "gre")).otherwise(F.col("r"))
    return h.groupBy(label.alias("label"), L.fatsat_flag("description", "options").alias("fat_sat"), L.contrast_flag("description", "agent", "dose").alias("contrast")).agg(F.count("*").alias("n"))


_N = {c: f"TRY_CAST({c} AS DOUBLE)" for c in ("tr", "te", "ti", "etl", "flip", "field", "b_value")}
_PFAT = f"({_words('(description || chr(32) || options)', L.PHYSICS_FATSAT_WORDS)} OR regexp_matches(upper(description), '\\bFAT[_\\-]SAT\\b') OR regexp_matches(upper(options), '\\bFAT[_\\-]SAT\\b'))"


@R.query(f"""{H}, n AS (SELECT scan, upper(description) AS up, upper(image_type) AS it, scanning, {', '.join(f'{v} AS {k}' for k, v in _N.items())},
 CASE WHEN {_PFAT} THEN 'FS' ELSE '' END AS fs,
 CASE WHEN {_NAMED} OR (trim(dose) <> '0' AND ((trim(agent) <> '' AND upper(trim(agent)) NOT IN ('NONE', 'NO', '0')) OR {_words('agent', L.AGENT_WORDS)})) THEN 'Contrast' ELSE '' END AS ce FROM headers),
b AS (SELECT *, CASE WHEN regexp_matches(up, 'CALI|LOC|SCOUT|SURVEY|ASSET') THEN 'loc' WHEN b_value > 0 OR contains(it, 'DIFFUSION') THEN 'dwi'
 WHEN ti > 0 THEN CASE WHEN (field < 2 AND ti BETWEEN 110 AND 190) OR (field >= 2 AND ti BETWEEN 150 AND 240) THEN 'stir' WHEN (field < 2 AND ti BETWEEN 1900 AND 2600) OR (field >= 2 AND ti BETWEEN 2400 AND 3200) THEN 'flair' WHEN te <= 30 AND tr < 4000 THEN 'irt1' ELSE 'ir' END
 WHEN scanning = 'GR' THEN CASE WHEN tr IS NULL OR te IS NULL THEN 'gu' WHEN tr <= 8 AND te <= 4 AND flip BETWEEN 35 AND 100 THEN 'gl' WHEN tr <= 20 AND te <= 6 THEN 'g1' WHEN te >= 6 THEN 'g2' ELSE 'g' END ELSE 'se' END AS k FROM n)
SELECT scan, CASE k WHEN 'loc' THEN 'Localizer' WHEN 'dwi' THEN 'DWI' WHEN 'stir' THEN 'T2W' WHEN 'flair' THEN 'T2W' WHEN 'irt1' THEN 'T1W' WHEN 'ir' THEN 'Unknown' WHEN 'gu' THEN 'Unknown_GRE' WHEN 'gl' THEN 'Localizer' WHEN 'g1' THEN 'T1W' WHEN 'g2' THEN 'T2*' WHEN 'g' THEN 'Unknown'
 ELSE CASE WHEN tr IS NULL OR te IS NULL THEN 'Unknown' WHEN te <= 25 THEN CASE WHEN tr <= 1100 THEN 'T1W' ELSE 'PD' END WHEN te >= 70 THEN 'T2W' WHEN tr < 1500 THEN 'T1W' ELSE 'T2W' END END AS sequence,
 CASE WHEN k = 'loc' THEN '' WHEN k IN ('dwi', 'se') THEN CASE WHEN etl >= 2 THEN 'FSE' ELSE 'SE' END WHEN k = 'flair' THEN 'FLAIR' WHEN k IN ('stir', 'irt1', 'ir') THEN 'IR' ELSE 'GRE' END AS acquisition,
 CASE WHEN k IN ('loc', 'gl') THEN '' WHEN k = 'stir' THEN 'STIR' ELSE fs END AS fat_sat, CASE WHEN k IN ('loc', 'gl') THEN '' ELSE ce END AS contrast FROM b""")
def physics_label(t):
    return L.physics_label(headers(t)).select("scan", "sequence", "acquisition", "fat_sat", "contrast")


RULES = [("T1", "T1"), ("T2", "T2|STIR"), ("PD", "PD"), ("metal", "STEEL|COPPER|BRASS"), ("coated", "PLATED|ANODIZED")]


@R.query(f"""{H}, m AS (SELECT scan, list_filter([{', '.join(f"CASE WHEN regexp_matches(description, '{p}') THEN '{c}' END" for c, p in RULES)}], lambda x: x IS NOT NULL) AS d, list_filter([{', '.join(f"CASE WHEN regexp_matches(type, '{p}') THEN '{c}' END" for c, p in RULES)}], lambda x: x IS NOT NULL) AS y FROM headers)
SELECT scan, array_to_string(CASE WHEN len(d) > 0 THEN d ELSE y END, ';') AS labels, CASE WHEN len(d) > 0 THEN 'description' WHEN len(y) > 0 THEN 'type' END AS source FROM m""")
def regex_taxonomy(t):
    return headers(t).select("scan", L.taxonomy_labels(["description", "type"], RULES).alias("x")).select("scan", F.array_join("x.labels", ";").alias("labels"), "x.source")


@R.query(" UNION ALL ".join(f"SELECT '{c}' AS class, '{p}' AS pattern, count_if(regexp_matches(p_type, '{p}')) AS hits FROM part" for c, p in RULES))
def regex_hits(t):
    one = t.part.agg(*[F.count_if(F.col("p_type").rlike(p)).alias(f"h{k}") for k, (_, p) in enumerate(RULES)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.lit(p).alias("pattern"), F.col(f"h{k}").alias("hits")) for k, (c, p) in enumerate(RULES)])).alias("x")).select("x.*")


@R.query(f"""{H}, m AS (SELECT scan, list_filter([{', '.join(f"CASE WHEN regexp_matches(type, '{p}') THEN '{c}' END" for c, p in RULES)}], lambda x: x IS NOT NULL) AS y FROM headers)
SELECT scan, y[1] AS label1, y[2] AS label2, len(y) > 2 AS error FROM m""")
def first_two_labels(t):
    x = headers(t).select("scan", L.taxonomy_labels(["type"], RULES)["labels"].alias("l"))
    return x.select("scan", L.first_two_labels("l").alias("x")).select("scan", "x.*")


@R.query("SELECT p_partkey, contains(lower(p_name), 'green') OR contains(lower(p_name), 'red') OR contains(lower(p_type), 'tin') AS member FROM part")
def keyword_member(t):
    return t.part.select("p_partkey", (X.keyword_member("p_name", ["green", "red"]) | X.keyword_member("p_type", ["tin"])).alias("member"))


@R.query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderpriority LIKE '1%' THEN 'full+urgent' ELSE 'F' END WHEN o_orderstatus = 'O' AND o_orderpriority LIKE '1%' THEN 'O_FS' ELSE o_orderstatus END AS label FROM orders")
def composite_label(t):
    x = t.orders.withColumn("fs", F.col("o_orderpriority").startswith("1")).withColumn("ce", F.lit(False))
    table = {("F", True, False): "full+urgent"}
    return x.select("o_orderkey", L.composite_label("o_orderstatus", F.col("fs") & (F.col("o_orderstatus") != "P"), "ce", table).alias("label"))


#: Reviewed predictions derived from orders: class, fat saturation and contrast.
PRED = ["o_orderkey AS id", "o_custkey AS subject", "CASE o_orderstatus WHEN 'F' THEN 'T1W' WHEN 'O' THEN 'T2W' ELSE 'DW' END AS w", "CASE WHEN o_orderkey % 3 = 0 THEN 'Y' WHEN o_orderkey % 3 = 1 THEN 'Y-STIR' ELSE 'N' END AS fs", "CASE WHEN o_orderkey % 2 = 0 THEN 'Y' ELSE '-' END AS c", "CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority END AS reference"]
PR = "WITH pred AS (SELECT " + ", ".join(PRED) + " FROM orders)"


def preds(t: Tables) -> DataFrame:
    return t.orders.selectExpr(*PRED)


_SAT = "CASE WHEN fs IN ('Y', 'Y-STIR') THEN 'FS' ELSE 'nFS' END"


@R.query(f"{PR} SELECT id, CASE w WHEN 'T1W' THEN w || '_' || {_SAT} || '_' || CASE WHEN c = 'Y' THEN 'CE' ELSE 'nCE' END WHEN 'T2W' THEN w || '_' || {_SAT} ELSE 'DWI' END AS label FROM pred")
def cascade_label(t):
    return preds(t).select("id", L.cascade_label("w", "fs", "c").alias("label"))


@R.query(f"{PR} SELECT id, w || '-' || fs || '-' || c AS plain, w || '-' || CASE WHEN fs = 'Y-STIR' THEN 'Y' ELSE fs END || '-' || CASE WHEN w = 'T1W' THEN c ELSE 'N' END AS folded FROM pred")
def modality_label(t):
    return preds(t).select("id", L.modality_label("w", "fs", "c").alias("plain"), L.modality_label("w", "fs", "c", True).alias("folded"))


@R.query(f"{PR} SELECT id, CASE WHEN reference = '' THEN 'Unlabeled' ELSE concat_ws(' ', reference, fs) END AS label FROM pred")
def label_parts_join(t):
    return preds(t).select("id", L.label_parts_join("reference", "fs").alias("label"))


@R.query(f"{PR} SELECT id, CASE WHEN reference = '' THEN 'no data' WHEN lower(reference) = '1-urgent' THEN 'agree' ELSE 'disagree' END AS status FROM pred")
def reference_text_label(t):
    return preds(t).select("id", L.reference_status(F.lit("1-URGENT"), "reference").alias("status"))


R.query(f"{PR} SELECT id, CASE WHEN reference = '' THEN 'no data' WHEN lower(reference) = lower(w) THEN 'agree' ELSE 'disagree' END AS status FROM pred", key="reference_label_color")(lambda t: preds(t).select("id", L.reference_status("w", "reference").alias("status")))
R.query(f"{PR} SELECT id, CASE WHEN fs = 'Y-STIR' THEN 'Y' ELSE fs END AS fs FROM pred", key="fold_values")(lambda t: preds(t).select("id", L.fold_values("fs", {"Y-STIR": "Y"}).alias("fs")))
R.query(f"{PR} SELECT id, CASE WHEN reference <> '' THEN 'Y' ELSE 'N' END AS has, CASE WHEN w IN ('T1W') THEN 'Y' ELSE 'N' END AS t1 FROM pred", key="to_yes_no")(lambda t: preds(t).select("id", L.to_yes_no("reference").alias("has"), L.to_yes_no("w", ["T1W"]).alias("t1")))
R.query("SELECT c_custkey, CASE lower(c_mktsegment) WHEN 'building' THEN 'construction' WHEN 'machinery' THEN 'machines' ELSE c_mktsegment END AS label FROM customer", key="translate_label")(lambda t: t.customer.select("c_custkey", L.translate_label("c_mktsegment", {"building": "construction", "machinery": "machines"}).alias("label")))
R.query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'works' WHEN 'FURNITURE' THEN 'home' ELSE 'uncertain' END AS category FROM customer", key="label_category")(lambda t: t.customer.select("c_custkey", L.label_category("c_mktsegment", {"BUILDING": "works", "FURNITURE": "home"}).alias("category")))
R.query(f"{PR} SELECT id, CASE w WHEN 'T1W' THEN 'A' WHEN 'T2W' THEN 'B' ELSE w END AS w2, CASE w WHEN 'T1W' THEN 'N' ELSE fs END AS fs2 FROM pred", key="decode_choice")(lambda t: preds(t).select("id", L.decode_choice("w", {"T1W": ("A", "N", "-"), "T2W": ("B", "", "")}, F.struct("w", "fs", "c")).alias("x"), "w", "fs").select("id", F.col("x.w").alias("w2"), F.when(F.col("w") == "T1W", F.col("x.fs")).otherwise(F.col("fs")).alias("fs2")))
R.query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'excluded' WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'both' WHEN o_orderstatus = 'F' THEN 'only_segmented' END AS status FROM orders", key="record_status")(lambda t: t.orders.select("o_orderkey", L.record_status(F.expr("CASE o_orderstatus WHEN 'F' THEN 'Done ' WHEN 'P' THEN 'exclude' ELSE '' END"), F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 'done' END")).alias("status")))
R.query("SELECT l_orderkey, CASE WHEN n >= 3 THEN '3-4' WHEN n = 2 THEN '2' WHEN n = 1 THEN '1' ELSE '0' END AS bucket FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)", key="count_bucket")(lambda t: t.lineitem.groupBy("l_orderkey").agg(L.count_bucket(F.count("*")).alias("bucket")))
R.query("SELECT p_partkey, CASE p_brand WHEN 'Brand#1' THEN 'one' WHEN 'Brand#2' THEN 'two' ELSE p_brand END AS code FROM part", key="map_codes")(lambda t: t.part.select("p_partkey", L.map_codes("p_brand", {"Brand#1": "one", "Brand#2": "two"}).alias("code")))
R.query("SELECT o_orderkey, (o_orderstatus = 'F')::INT AS s_F, (o_orderstatus = 'O')::INT AS s_O, (o_orderstatus = 'X')::INT AS s_X FROM orders", key="one_hot")(lambda t: t.orders.select("o_orderkey", *L.one_hot("o_orderstatus", ["F", "O", "X"], "s")))
R.query("SELECT o_orderkey, contains('1-URGENT', o_orderpriority)::INT AS p_u, contains('xx2-HIGHxx', o_orderpriority)::INT AS p_h FROM orders", key="one_hot_contains")(lambda t: t.orders.select("o_orderkey", *[c.alias(n) for c, n in zip(L.one_hot_contains(F.concat(F.lit("'"), "o_orderpriority", F.lit("'")), ["1-URGENT", "xx2-HIGHxx"], "p"), ["p_u", "p_h"], strict=True)]))
R.query("SELECT o_orderkey, greatest((o_orderstatus = 'F')::INT, (o_orderstatus = 'O')::INT) AS any_flag FROM orders", key="or_columns")(lambda t: t.orders.select("o_orderkey", *L.one_hot("o_orderstatus", ["F", "O"], "s")).select("o_orderkey", L.or_columns("s_F", "s_O").alias("any_flag")))
R.query(f"{H} SELECT scan, coalesce(TRY_CAST(tr AS DOUBLE), 0) AS tr0, coalesce(TRY_CAST(ti AS DOUBLE), 0) AS ti0, array_to_string(list_filter([CASE WHEN TRY_CAST(tr AS DOUBLE) IS NULL THEN 'tr' END, CASE WHEN TRY_CAST(ti AS DOUBLE) IS NULL THEN 'ti' END], lambda x: x IS NOT NULL), ';') AS filled FROM headers", key="null_to_zero_flagged")(lambda t: headers(t).select("scan", L.filled_zero(["tr", "ti"]).alias("x")).select("scan", F.col("x.tr").alias("tr0"), F.col("x.ti").alias("ti0"), F.array_join("x.filled", ";").alias("filled")))
R.query("SELECT p_partkey, CASE WHEN contains(lower(p_brand), '#1') THEN 'First' WHEN contains(lower(p_brand), '#2') THEN 'Second' ELSE p_brand END AS vendor FROM part", key="manufacturer_norm")(lambda t: t.part.select("p_partkey", L.manufacturer_norm("p_brand", {"#1": "First", "#2": "Second"}).alias("vendor")))
R.query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS first FROM part", key="first_element_number")(lambda t: t.part.select("p_partkey", L.first_element_number(F.concat(F.lit("["), F.col("p_size").cast("string"), F.lit(", 3]"))).alias("first")))
R.query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '1' ELSE o_orderstatus END AS code, substr(o_orderpriority, 1, 3) AS prefix FROM orders", key="gender_code")(lambda t: t.orders.select("o_orderkey", L.gender_code("o_orderstatus").alias("code"), F.substring("o_orderpriority", 1, 3).alias("prefix")))
R.query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' ELSE 'Unknown' END AS sex FROM orders", key="sex_decode")(lambda t: t.orders.select("o_orderkey", L.sex_decode(F.col("o_orderkey") % 3).alias("sex")))
R.query("SELECT p_partkey, CASE split_part(p_type, ' ', 1) WHEN 'SMALL' THEN 'small part' WHEN 'LARGE' THEN 'large part' ELSE split_part(p_type, ' ', 1) || '_TIN' END || CASE WHEN split_part(p_type, ' ', 1) IN ('SMALL', 'LARGE') THEN ' in tin' ELSE '' END AS text FROM part", key="describe_code")(lambda t: t.part.select("p_partkey", L.describe_code(F.concat(F.split_part("p_type", F.lit(" "), F.lit(1)), F.lit("_TIN")), {"SMALL": "small part", "LARGE": "large part"}, {"TIN": "in tin"}).alias("text")))
R.query(f"{PR} SELECT id, concat_ws('; ', 'modality: ' || w, 'priority: ' || nullif(reference, '')) AS context FROM pred", key="build_context")(lambda t: preds(t).select("id", L.build_context(modality="w", priority="reference").alias("context")))
R.query("SELECT p_partkey, CASE WHEN p_name LIKE '%steel%' THEN 'x' END AS label, p_size::DOUBLE AS size FROM part", key="bti_rules")(lambda t: t.part.select("p_partkey", F.when(F.col("p_name").contains("steel"), "x").alias("label"), L.bti_size(F.concat(F.col("p_size").cast("string"), F.lit(" mm"))).alias("size")))

# ------------------------------------------------------------ text, paths, dates, numbers
R.query(f"{PR} SELECT id, coalesce(nullif(trim(reference), ''), 'absent') AS t FROM pred", key="norm_text")(lambda t: preds(t).select("id", X.norm_text("reference", "absent").alias("t")))
R.query(f"{PR} SELECT id, trim(reference) <> '' AS present FROM pred", key="is_present")(lambda t: preds(t).select("id", X.is_present("reference").alias("present")))
R.query("SELECT page_id, coalesce(nullif(regexp_extract(url, 'utm_source=(\\w+)', 1), ''), nullif(regexp_extract(url, '/(\\d+)', 1), '')) AS id FROM pages", key="extract_id_fallback")(lambda t: t.pages.select("page_id", F.coalesce(X.extract_first(["url"], r"utm_source=(\w+)", 1), X.extract_first(["url"], r"/(\d+)", 1)).alias("id")))
R.query("SELECT page_id, split_part(url, '/', -1) AS last, split_part(url, '/', -2) AS parent FROM pages", key="path_components")(lambda t: t.pages.select("page_id", X.path_part("url", 1).alias("last"), X.path_part("url", 2).alias("parent")))
R.query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'batch_' || page_id % 5 ELSE 'sub' END AS batch FROM pages", key="extract_batch")(lambda t: t.pages.select("page_id", X.batch_of(F.expr("CASE WHEN page_id % 2 = 0 THEN concat('r/batch_', page_id % 5, '/x/f') ELSE 'r/sub/f' END")).alias("batch")))
R.query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '/new/deep/' || page_id WHEN page_id % 3 = 1 THEN '/new2/' || page_id ELSE '/database/' || page_id END AS path FROM pages", key="remap_prefix")(lambda t: t.pages.select("page_id", X.remap_prefix(F.expr("CASE page_id % 3 WHEN 0 THEN concat('/data/a/', page_id) WHEN 1 THEN concat('/data/', page_id) ELSE concat('/database/', page_id) END"), {"/data": "/new2", "/data/a": "/new/deep"}).alias("path")))
R.query("SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS token FROM pages", key="safe_token")(lambda t: t.pages.select("page_id", X.safe_token("url").alias("token")))
R.query("SELECT page_id, sha256(page_id::VARCHAR || '|' || url) AS uid FROM pages", key="stable_uid")(lambda t: t.pages.select("page_id", X.stable_uid("page_id", "url").alias("uid")))
R.query("SELECT page_id, page_id::INT AS n, 'scan ' || page_id AS rest FROM pages", key="leading_number")(lambda t: t.pages.select("page_id", F.expr("concat(page_id, '_scan ', page_id)").alias("s")).select("page_id", X.leading_number("s").alias("n"), X.strip_leading_number("s").alias("rest")))
R.query("SELECT page_id, page_id::INT AS b FROM pages", key="bvalue_from_name")(lambda t: t.pages.select("page_id", X.bvalue_from_name(F.expr("concat('dwi_b', page_id, '_ax')")).alias("b")))
R.query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 0 END AS shots FROM pages", key="shots_from_name")(lambda t: t.pages.select("page_id", X.shots_from_name(F.expr("CASE page_id % 3 WHEN 0 THEN 'run_fs_4' WHEN 1 THEN 'run_fs' ELSE 'run' END")).alias("shots")))
R.query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS a, strftime(o_orderdate, '%Y%m%d') AS b FROM orders", key="date8_from_text")(lambda t: t.orders.select("o_orderkey", X.date8(F.concat(F.lit("s_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_x"))).alias("a"), X.date8(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("b")))
R.query("SELECT o_orderkey, strftime(o_orderdate - INTERVAL 2 HOUR, '%Y%m%d') AS day FROM orders", key="study_date_utc")(lambda t: t.orders.select("o_orderkey", F.date_format(F.to_timestamp(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))), "yyyyMMdd").alias("day")))
R.query("SELECT o_orderkey, date_diff('day', DATE '1980-01-01', o_orderdate::DATE) / 365.25::DOUBLE AS age FROM orders", key="age_years")(lambda t: t.orders.select("o_orderkey", X.age_years(X.day_first(F.lit("01/01/1980")), "o_orderdate").alias("age")))
R.query("SELECT p_partkey, trim(split_part(p_name || ', x', ',', 1)) AS first FROM part", key="first_list_item")(lambda t: t.part.select("p_partkey", X.first_list_item(F.concat("p_name", F.lit(", x"))).alias("first")))
R.query(f"{H} SELECT scan, TRY_CAST(tr AS DOUBLE) AS tr FROM headers", key="to_number")(lambda t: headers(t).select("scan", X.to_number("tr").alias("tr")))
R.query("SELECT o_orderkey, CASE WHEN b >= 1073741824 THEN printf('%.1f GB', round(b / 1073741824, 1)) WHEN b >= 1048576 THEN printf('%.1f MB', round(b / 1048576, 1)) WHEN b >= 1024 THEN printf('%.1f KB', round(b / 1024, 1)) ELSE printf('%.1f B', round(b, 1)) END AS size FROM (SELECT o_orderkey, (o_orderkey * 1003)::DOUBLE AS b FROM orders)", key="human_bytes")(lambda t: t.orders.select("o_orderkey", X.human_bytes(F.col("o_orderkey") * 1003).alias("size")))
R.query(f"{PR} SELECT id, concat_ws(', ', w, nullif(reference, '')) AS place FROM pred", key="location_text")(lambda t: preds(t).select("id", X.location_text("w", "reference").alias("place")))
R.query("SELECT p_partkey, regexp_replace(p_type, '(?i)POLISHED|PLATED|TIN', '', 'g') AS t FROM part", key="remove_words")(lambda t: t.part.select("p_partkey", X.remove_words("p_type", ["tin", "plated", "polished"]).alias("t")))
R.query("SELECT p_partkey, regexp_replace(replace(lower(p_type), '*', 'star'), '[^a-z0-9]', '', 'g') AS t FROM part", key="clean_tag_text")(lambda t: t.part.select("p_partkey", X.clean_tag_text("p_type").alias("t")))
R.query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'a/' || page_id || '_overlay.png' END AS path FROM pages", key="sibling_path")(lambda t: t.pages.select("page_id", X.sibling_path(F.expr("CASE WHEN page_id % 2 = 0 THEN concat('a/', page_id, '.png') ELSE concat('a/', page_id) END")).alias("path")))

# ------------------------------------------------------------ maps, packed lists, boxes
R.query("SELECT event_id, (props->>'$.k')::DOUBLE AS k FROM events", key="parse_proba_map")(lambda t: t.events.select("event_id", F.element_at(M.parse_proba_map("props"), "k").alias("k")))
R.query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS kind, 'true' AS ok FROM events", key="parse_literal_map")(lambda t: t.events.select("event_id", M.parse_literal_map(F.expr("concat('{\"kind\": ', CASE WHEN event_id % 2 = 0 THEN concat('\"', event_type, '\"') ELSE 'None' END, ', \"ok\": True}')")).alias("m")).select("event_id", F.element_at("m", "kind").alias("kind"), F.element_at("m", "ok").alias("ok")))
R.query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS n FROM events", key="parse_list_literal")(lambda t: t.events.select("event_id", F.size(M.parse_list_literal(F.expr("CASE WHEN event_id % 2 = 0 THEN concat('[\"', event_type, '\", \"x\"]') ELSE event_type END"))).alias("n")))
R.query("SELECT p_partkey, p_size::VARCHAR AS k, '0.24' AS amp FROM part", key="parse_kv_pairs")(lambda t: t.part.select("p_partkey", M.parse_kv_pairs(F.expr("concat('k=', p_size, ';amp=0.24')")).alias("m")).select("p_partkey", F.element_at("m", "k").alias("k"), F.element_at("m", "amp").alias("amp")))
R.query("SELECT p_partkey, p_size AS r0, p_size + 9 AS r1, 3 AS c0, 8 AS c1 FROM part", key="parse_box")(lambda t: t.part.select("p_partkey", M.parse_box(F.expr("concat('[', p_size, ',', p_size + 9, ',3,8]')")).alias("b")).select("p_partkey", "b.*"))
R.query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN greatest(p_size, 7) ELSE p_size END AS px FROM part", key="parse_margin")(lambda t: t.part.select("p_partkey", M.parse_margin(F.expr("CASE WHEN p_partkey % 2 = 0 THEN concat('12mm=(', p_size, ',7)px|bbox') ELSE concat(p_size, 'px') END")).alias("px")))
R.query("SELECT p_partkey, least(1.0::DOUBLE, greatest(0.05::DOUBLE, (p_size - 8.0::DOUBLE) / p_size)) AS f FROM part", key="lesion_fraction")(lambda t: t.part.select("p_partkey", M.lesion_fraction("p_size", F.lit(4)).alias("f")))
R.query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'a;b' ELSE 'unknown' END AS v FROM events", key="doc_feature_label")(lambda t: t.events.select("event_id", M.doc_feature_label(F.expr("CASE event_id % 3 WHEN 0 THEN map('shape', '', 'form', event_type) WHEN 1 THEN map('shape', '[\"a\",\"b\"]') ELSE map('other', 'x') END"), "shape", "form").alias("v")))
R.query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 1.15::DOUBLE ELSE 1.65::DOUBLE END AS total FROM part", key="resolve_levels")(lambda t: t.part.select("p_partkey", F.round(F.aggregate(M.resolve_levels(F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'easy, 0.15, x' ELSE 'hard,0.65' END"), {"easy": 1.0, "hard": 1.0}), F.lit(0.0), lambda a, x: a + x), 6).alias("total")))
R.query(f"{PR} SELECT id, CASE WHEN reference = '' THEN 1 ELSE 2 END AS n, nullif(reference, '') AS ref FROM pred", key="request_map")(lambda t: preds(t).select("id", M.request_map(w="w", ref="reference").alias("m")).select("id", F.size("m").alias("n"), F.element_at("m", "ref").alias("ref")))
R.query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'fixed' ELSE props->>'$.k' END AS k FROM events", key="patch_map_fields")(lambda t: t.events.select("event_id", F.element_at(M.patch_map(F.from_json("props", "map<string,string>"), F.expr("CASE WHEN event_id % 2 = 0 THEN map('k', 'fixed') END")), "k").alias("k")))

# ------------------------------------------------------------ model replies built from events
REPLY = """CASE event_id % 7 WHEN 0 THEN concat('<think>hm {"answer":"no"}</think> {"answer": "', upper(event_type), '", "reason": "r"}') WHEN 1 THEN concat('```json\n{"answer": "', event_type, '"}\n```')
 WHEN 2 THEN '<think>never ends' WHEN 3 THEN concat('I say ', event_type, '.') WHEN 4 THEN 'click or view' WHEN 5 THEN concat('answer: ', event_type) ELSE '' END"""
OPTIONS = ("click", "view", "purchase", "error", "login", "signup", "logout")
_LOW = "event_type IN (" + ", ".join(f"'{o}'" for o in OPTIONS) + ")"
_ANSWER = f"CASE WHEN event_id % 7 IN (0, 1, 3, 5) AND {_LOW} THEN event_type ELSE 'PARSE_FAILED' END"


def options():
    return F.array(*[F.lit(o) for o in OPTIONS])


def replies(t: Tables) -> DataFrame:
    return t.events.withColumn("reply", F.expr(REPLY))


R.query("SELECT event_id, event_id % 7 = 2 AS cut FROM events", key="was_truncated")(lambda t: replies(t).select("event_id", P.was_truncated("reply").alias("cut")))
R.query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'hm {"answer":"no"}' WHEN 2 THEN 'never ends' END AS thinking FROM events""", key="extract_thinking")(lambda t: replies(t).select("event_id", P.extract_thinking("reply").alias("thinking")))
R.query("SELECT event_id, CASE event_id % 7 WHEN 0 THEN upper(event_type) WHEN 1 THEN event_type END AS answer FROM events", key="extract_json")(lambda t: replies(t).select("event_id", F.element_at(P.extract_json("reply"), "answer").alias("answer")))
R.query(f"SELECT event_id, {_ANSWER} AS label, CASE WHEN event_id % 7 = 0 THEN 'r' ELSE '' END AS reason FROM events", key="parse_answer")(lambda t: P.parse_answers(replies(t), "reply", options()).select("event_id", "label", "reason"))
R.query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'a' ELSE 'PARSE_FAILED' END AS label, CASE event_id % 3 WHEN 0 THEN 'a > b = c' WHEN 1 THEN 'a = b > c' END AS ranking FROM events", key="parse_ranking")(lambda t: t.events.select("event_id", P.parse_ranking(F.expr("CASE event_id % 3 WHEN 0 THEN 'so:\nA > b = c' WHEN 1 THEN 'a = b > c' ELSE 'a > b' END"), F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("x")).select("event_id", "x.label", "x.ranking"))
R.query("SELECT event_id, event_id % 2 = 0 AS loops FROM events", key="is_degenerate")(lambda t: t.events.select("event_id", P.is_degenerate(F.expr("CASE WHEN event_id % 2 = 0 THEN repeat('this sentence comes again. ', 6) ELSE 'this sentence comes again. once only here' END")).alias("loops")))
R.query(f"SELECT event_id, CASE WHEN {_ANSWER} <> 'PARSE_FAILED' THEN {_ANSWER} = 'click' END AS correct FROM events", key="score_answer")(lambda t: P.parse_answers(replies(t), "reply", options()).select("event_id", P.score_answer("label", F.lit("click")).alias("correct")))
R.query("SELECT conv_id, string_agg('[' || role || '] ' || text, ' ' ORDER BY turn) AS rendered FROM conversations GROUP BY conv_id", key="render_messages")(lambda t: t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m")).select("conv_id", P.render_messages("m").alias("rendered")))

QUERIES, ORACLE = R.queries, R.oracle
