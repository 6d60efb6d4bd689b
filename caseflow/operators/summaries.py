"""Summaries of classifiers and reviews: gated stages, class reports, binary tasks, agreement, progress, shapes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import auc_rank, roc_curve, youden_cutoff


@dataclass
class Stage:
    """A head of a cascade: the rows it judges, and what it is judged by; ``probabilities`` is a map class -> double."""

    name: str
    truth: Column
    pred: Column
    confidence: Column
    classes: list[str]
    gate: Column | None = None
    probabilities: Column | None = None


def per_class(cells: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """(by, class, support, predicted, tp, precision, recall, f1) of the wanted classes from confusion cells (by, truth,
    pred, n); undefined values are null, and so is f1 where precision or recall is 0 or null."""
    same = F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)
    roles = F.array(F.struct(F.col("truth").alias("class"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), same.cast("long").alias("tp")), F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("tp")))
    sums = cells.select(*by, F.explode(roles).alias("r")).select(*by, "r.*").groupBy(*by, "class").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("tp").alias("tp"))
    found = wanted.join(sums, [*by, "class"], "left").fillna(0, ["support", "predicted", "tp"])
    found = found.withColumns({"precision": F.try_divide(F.col("tp").cast("double"), F.col("predicted")), "recall": F.try_divide(F.col("tp").cast("double"), F.col("support"))})
    p, r = F.col("precision"), F.col("recall")
    return found.withColumn("f1", F.when((p > 0) & (r > 0), 2 * p * r / (p + r)))


def evaluate_stages(df: DataFrame, stages: list[Stage]) -> DataFrame:
    """(stage, n, accuracy, macro_precision, macro_recall, macro_f1, confidence_auc, macro_ovr_auc), a row per stage.

    Macro values are means over a stage's classes where defined; ``confidence_auc`` ranks right rows against wrong ones,
    ``macro_ovr_auc`` is the mean of the defined one-vs-rest AUCs of its classes. All stages share one confusion count
    and one AUC pass. A stage without rows has n 0 and nulls.
    """
    spark, none = df.sparkSession, F.lit(None).cast("map<string,double>")
    rows = [F.when(s.gate if s.gate is not None else F.lit(True), F.struct(F.lit(s.name).alias("stage"), s.truth.cast("string").alias("truth"), s.pred.cast("string").alias("pred"), s.confidence.cast("double").alias("confidence"), (none if s.probabilities is None else s.probabilities.cast("map<string,double>")).alias("probabilities"))) for s in stages]
    x = df.select(F.explode(F.array_compact(F.array(*rows))).alias("x")).select("x.*")
    wanted = spark.createDataFrame([(s.name, c) for s in stages for c in s.classes], "stage string, class string")
    cells = x.groupBy("stage", "truth", "pred").agg(F.count(F.lit(1)).alias("n"))
    overall = cells.groupBy("stage").agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    macro = per_class(cells, wanted, ["stage"]).groupBy("stage").agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])
    right = F.coalesce(F.col("truth") == F.col("pred"), F.lit(False))
    own = F.array(F.struct(F.lit(None).cast("string").alias("class"), F.col("confidence").alias("s"), right.alias("y")))
    rest = F.transform(F.map_entries("probabilities"), lambda e: F.struct(e["key"].alias("class"), e["value"].alias("s"), F.coalesce(F.col("truth") == e["key"], F.lit(False)).alias("y")))
    scores = x.select("stage", F.explode(F.concat(own, F.coalesce(rest, F.array().cast("array<struct<class:string,s:double,y:boolean>>")))).alias("v")).select("stage", "v.*")
    auc = auc_rank(scores, F.col("y"), "s", ["stage", "class"]).select("stage", "class", "auc")
    confidence = auc.where(F.col("class").isNull()).select("stage", F.col("auc").alias("confidence_auc"))
    one_vs_rest = auc.join(wanted, ["stage", "class"], "left_semi").groupBy("stage").agg(F.avg("auc").alias("macro_ovr_auc"))
    out = spark.createDataFrame([(s.name,) for s in stages], "stage string")
    for part in (overall, macro, confidence, one_vs_rest):
        out = out.join(part, "stage", "left")
    return out.fillna(0, ["n"])


def ovr_auc(df: DataFrame, truth: str, probabilities: str, classes: list[str]) -> DataFrame:
    """(class, auc): one-vs-rest AUC of each declared class from a map class -> probability, null if undefined, and a row
    ``macro`` with the mean of the defined ones."""
    entry = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(probabilities)[F.lit(c)].cast("double").alias("s")) for c in classes]))
    x = df.select(F.col(truth).cast("string").alias("_t"), entry.alias("v")).select("_t", "v.*")
    wanted = df.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    each = wanted.join(auc_rank(x, F.coalesce(F.col("_t") == F.col("class"), F.lit(False)), "s", ["class"]).select("class", "auc"), "class", "left")
    return each.rollup("class").agg(F.avg("auc").alias("auc")).select(F.coalesce("class", F.lit("macro")).alias("class"), "auc")


def class_report(df: DataFrame, truth: str, pred: str, labels: list[str], all_rows: str = "ALL") -> DataFrame:
    """(class, n, predicted, recall, precision, confusion, accuracy, balanced, chance): a row per label, and a row ALL.

    ``confusion`` has a label's row counts in the labels' order, joined by commas; accuracy, balanced accuracy (the mean
    recall of labels that occur) and chance are in the row ALL. Rows whose truth is no label are left out."""
    wanted = df.sparkSession.createDataFrame([(c,) for c in labels], "class string")
    known = df.where(F.col(truth).cast("string").isin(labels))
    cells = known.groupBy(F.col(truth).cast("string").alias("truth"), F.col(pred).cast("string").alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    each = per_class(cells, wanted, [])
    row = cells.groupBy(F.col("truth").alias("class")).agg(F.concat_ws(",", *[F.sum(F.when(F.col("pred") == c, F.col("n")).otherwise(0)).cast("string") for c in labels]).alias("confusion"))
    null = lambda kind: F.lit(None).cast(kind)
    rows = each.join(row, "class", "left").select("class", F.col("support").alias("n"), "predicted", "recall", "precision", F.coalesce("confusion", F.lit(",".join("0" for _ in labels))).alias("confusion"), null("double").alias("accuracy"), null("double").alias("balanced"), null("double").alias("chance"))
    total = each.agg(F.sum("support").alias("n"), F.sum("predicted").alias("predicted"), F.try_divide(F.sum("tp").cast("double"), F.sum("support")).alias("accuracy"), F.avg("recall").alias("balanced"))
    total = total.select(F.lit(all_rows).alias("class"), "n", "predicted", null("double").alias("recall"), null("double").alias("precision"), null("string").alias("confusion"), "accuracy", "balanced", F.lit(1.0 / len(labels) if labels else None).cast("double").alias("chance"))
    return rows.unionByName(total)


def binary_tasks(df: DataFrame, group: str, scores: list[str], tasks: dict[str, tuple[list[str], list[str]]], cutoffs: dict[str, list[float]]) -> DataFrame:
    """(task, score, cutoff, kind, n_pos, n_neg, auc, tp, fp, fn, tn, sensitivity, specificity, ppv, npv, accuracy): each
    task sets some groups (positive) against others; rows of other groups, and without the score, are left out.

    For each score AUC over all its rows, and counts at its given cut-offs (``fixed``) and at its Youden cut-off, which
    is taken from the data (``youden``). All of it comes from one count by task, score and distinct value."""
    sides = [F.when(F.col(group).isin(pos), F.struct(F.lit(t).alias("task"), F.lit(True).alias("y"))).when(F.col(group).isin(neg), F.struct(F.lit(t).alias("task"), F.lit(False).alias("y"))) for t, (pos, neg) in tasks.items()]
    long = df.select(F.explode(F.array_compact(F.array(*sides))).alias("t"), F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).cast("double").alias("s")) for s in scores]).alias("v")).select("t.*", F.explode("v").alias("v")).select("task", "y", "v.*").where("s is not null")
    keys = ["task", "score"]
    auc = auc_rank(long, F.col("y"), "s", keys)
    youden = youden_cutoff(roc_curve(long, F.col("y"), "s", keys), keys).select(*keys, "cutoff", F.lit("youden").alias("kind"))
    fixed = df.sparkSession.createDataFrame([(t, s, float(c), "fixed") for t in tasks for s in scores for c in cutoffs.get(s, [])], "task string, score string, cutoff double, kind string")
    values = long.groupBy(*keys, "s").agg(F.count_if("y").alias("p"), F.count_if(~F.col("y")).alias("n"))
    at = values.join(fixed.unionByName(youden), keys).groupBy(*keys, "cutoff", "kind")
    hit = F.col("s") >= F.col("cutoff")
    pick = lambda c, where: F.coalesce(F.sum(F.when(where, F.col(c))), F.lit(0)).cast("long")
    m = at.agg(pick("p", hit).alias("tp"), pick("n", hit).alias("fp"), pick("p", ~hit).alias("fn"), pick("n", ~hit).alias("tn")).join(auc, keys)
    rate = lambda a, *b: F.try_divide(a.cast("double"), sum(b[1:], b[0]))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return m.select("task", "score", "cutoff", "kind", "n_pos", "n_neg", "auc", "tp", "fp", "fn", "tn", rate(tp, tp, fn).alias("sensitivity"), rate(tn, tn, fp).alias("specificity"), rate(tp, tp, fp).alias("ppv"), rate(tn, tn, fn).alias("npv"), rate(tp + tn, tp, fp, fn, tn).alias("accuracy"))


def agreement_report(df: DataFrame, a: str, b: str, facets: list[str], truth: dict[str, str] | None = None) -> DataFrame:
    """(section, value, share, n): agreement of two runs overall and by each facet (a null label agrees with nothing), and
    each run's accuracy where its ``truth`` (run column -> truth column) and label are known. One pass."""
    same = F.coalesce(F.col(a) == F.col(b), F.lit(False))
    entry = lambda section, value, hit: F.struct(F.lit(section).alias("section"), value.cast("string").alias("value"), hit.cast("double").alias("hit"))
    rows = [entry("overall", F.lit("all"), same), *[entry(f, F.col(f), same) for f in facets]]
    rows += [F.when(F.col(run).isNotNull() & F.col(t).isNotNull(), entry("accuracy", F.lit(run), F.col(run) == F.col(t))) for run, t in (truth or {}).items()]
    x = df.select(F.explode(F.array_compact(F.array(*rows))).alias("x")).select("x.*")
    return x.groupBy("section", "value").agg(F.avg("hit").alias("share"), F.count(F.lit(1)).alias("n"))


def review_progress(df: DataFrame, by: list[str], reviewed: Column) -> DataFrame:
    """(by, value, total, reviewed, remaining) for each value of each of the columns ``by``, in one pass."""
    x = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("by"), F.col(c).cast("string").alias("value")) for c in by])).alias("k"), F.coalesce(reviewed, F.lit(False)).alias("_r")).select("k.*", "_r")
    return x.groupBy("by", "value").agg(F.count(F.lit(1)).alias("total"), F.count_if("_r").alias("reviewed"), F.count_if(~F.col("_r")).alias("remaining"))


def category_rollup(df: DataFrame, subject: str, status: Column, second: Column) -> DataFrame:
    """(subject, both, only_segmented, excluded, best, mixed): rows of each category and the subject's best one.

    A row whose status is ``done`` is ``both`` if it has a second review, else ``only_segmented``; one that is ``exclude``
    is ``excluded``; others have no category. Best: both, then only_segmented, then excluded. ``mixed`` subjects have
    excluded rows and others. Rows without a subject are left out."""
    state = F.lower(F.trim(F.coalesce(status.cast("string"), F.lit(""))))
    again = F.trim(F.coalesce(second.cast("string"), F.lit(""))) != ""
    kind = F.when(state == "exclude", "excluded").when(state == "done", F.when(again, "both").otherwise("only_segmented"))
    name = F.trim(F.coalesce(F.col(subject).cast("string"), F.lit("")))
    g = df.select(F.col(subject), kind.alias("_k")).where(F.col("_k").isNotNull() & (name != "")).groupBy(subject)
    g = g.agg(*[F.count_if(F.col("_k") == k).alias(k) for k in ("both", "only_segmented", "excluded")])
    best = F.when(F.col("both") > 0, "both").when(F.col("only_segmented") > 0, "only_segmented").otherwise("excluded")
    return g.withColumns({"best": best, "mixed": (F.col("excluded") > 0) & (F.col("both") + F.col("only_segmented") > 0)})


def shape_report(df: DataFrame, shape: str, error: str) -> DataFrame:
    """(kind, value, n): files by number of dimensions (``ndim``), those of four by the size of the last (``axis4``), files
    by note (``note``: ok, 4D-multivolume, UNEXPECTED-NDIM or ERROR), and each error's text (``error``)."""
    nd, bad = F.size(shape), F.col(error).isNotNull() | F.col(shape).isNull()
    note = F.when(bad, "ERROR").when(nd == 3, "ok").when(nd == 4, "4D-multivolume").otherwise("UNEXPECTED-NDIM")
    entry = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    rows = F.array_compact(F.array(entry("note", note), F.when(~bad, entry("ndim", nd)), F.when(~bad & (nd == 4), entry("axis4", F.get(shape, F.lit(3)))), F.when(bad, entry("error", F.coalesce(F.col(error), F.lit("no shape"))))))
    return df.select(F.explode(rows).alias("x")).select("x.*").groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


def pivot_mean(df: DataFrame, row: str, column: str, value: str, values: list[str]) -> DataFrame:
    """(row, a column for each of ``values``): the mean of ``value``, null where there is none."""
    return df.groupBy(row).pivot(column, values).agg(F.avg(value))
