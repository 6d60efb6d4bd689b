"""Counts, confusion, agreement, ROC, cut-offs, votes and profiles. Undefined values are null."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.reply import PARSE_FAILED


def value_counts_pct(df: DataFrame, c: str) -> DataFrame:
    """(value, n, pct): counts with nulls, percent to two places."""
    n = df.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("_all"))  # one row
    return n.crossJoin(F.broadcast(total)).withColumn("pct", F.round(F.col("n") * 100.0 / F.col("_all"), 2)).drop("_all")


def count_with_subjects(df: DataFrame, label: str, subject: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"), F.count_distinct(subject).alias("subjects"))


def subject_sketches(df: DataFrame, by: list[str], subject: str, log_registers: int = 14) -> DataFrame:
    """(by, n, sketch): rows, and a mergeable sketch of the distinct subjects; nulls aren't counted. Sketches of parts, such
    as days, are merged by :func:`merge_sketches` without reading the parts again."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.hll_sketch_agg(F.col(subject).cast("string"), log_registers).alias("sketch"))


def merge_sketches(parts: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, sketch) of the union of parts."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("sketch").alias("sketch"))


def estimated_subjects(sketches: DataFrame) -> DataFrame:
    """``sketches`` with ``subjects``, the estimated number of distinct subjects, in place of the sketch. The relative
    standard error is about 0.8 / sqrt(2 ** log_registers): 0.7 % by default."""
    return sketches.withColumn("subjects", F.hll_sketch_estimate("sketch")).drop("sketch")


def estimated_overlap(df: DataFrame, known: DataFrame, batch: str, key: str, log_registers: int = 14) -> DataFrame:
    """Estimates of :func:`overlap_summary` per batch from sketches: ids in all, new ones and known ones, without a join."""
    have = known.agg(F.hll_sketch_agg(F.col(key).cast("string"), log_registers).alias("_have"))  # one row
    x = subject_sketches(df, [batch], key, log_registers).crossJoin(F.broadcast(have))
    total, union, old = F.hll_sketch_estimate("sketch"), F.hll_sketch_estimate(F.hll_union("sketch", "_have")), F.hll_sketch_estimate("_have")
    new = F.greatest(F.lit(0), F.least(total, union - old))
    return x.select(batch, total.alias("total"), (total - new).alias("known"), new.alias("new"))


def crosstab_margins(df: DataFrame, a: str, b: str, total: str = "TOTAL") -> DataFrame:
    """(a, b, n) of both labels with TOTAL rows and columns, in one pass."""
    cube = df.cube(a, b).agg(F.count("*").alias("n"), F.grouping(a).alias("_a"), F.grouping(b).alias("_b"))
    return cube.select(F.when(F.col("_a") == 1, total).otherwise(F.col(a)).alias(a), F.when(F.col("_b") == 1, total).otherwise(F.col(b)).alias(b), "n")


def confusion_table(df: DataFrame, truth: str, pred: str, classes: list[str]) -> DataFrame:
    """(truth, pred, n) for every pair of declared classes, zero where none, and for the other pairs that occur."""
    spark = df.sparkSession
    names = spark.createDataFrame([(c,) for c in classes], "c string")
    grid = names.select(F.col("c").alias("truth")).crossJoin(F.broadcast(names.select(F.col("c").alias("pred"))))
    seen = df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    return grid.join(seen, ["truth", "pred"], "full_outer").select("truth", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def confusion_pct(table: DataFrame, by: str = "truth") -> DataFrame:
    """Share of each cell in its row's (or column's) total, percent."""
    return table.withColumn("pct", F.try_divide(F.col("n") * 100.0, F.sum("n").over(Window.partitionBy(by))))


def per_class_metrics(df: DataFrame, truth: str, pred: str, by: list[str] = ()) -> DataFrame:
    """(class, support, tp, fp, fn, precision, recall, f1) from one aggregation; f1 is null if either is null or 0."""
    roles = F.array(F.struct(F.col(truth).alias("class"), F.lit(1).alias("t"), (F.col(truth) == F.col(pred)).cast("int").alias("p")), F.struct(F.col(pred).alias("class"), F.lit(0).alias("t"), F.lit(1).alias("p")))
    x = df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).select(*by, F.explode(roles).alias("r")).select(*by, "r.*")
    g = x.groupBy(*by, "class").agg(F.sum("t").alias("support"), F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum((1 - F.col("t")) * F.col("p")).alias("_pred"))
    g = g.withColumn("fp", F.col("_pred") - F.col("tp")).withColumn("fn", F.col("support") - F.col("tp"))
    g = g.withColumn("precision", F.try_divide(F.col("tp").cast("double"), F.col("_pred"))).withColumn("recall", F.try_divide(F.col("tp").cast("double"), F.col("support")))
    p, r = F.col("precision"), F.col("recall")
    return g.withColumn("f1", F.when((p > 0) & (r > 0), 2 * p * r / (p + r))).drop("_pred")


def overall_accuracy(df: DataFrame, truth: str, pred: str, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col(truth) == F.col(pred)).cast("double")).alias("accuracy"))


def macro_metrics(per_class: DataFrame, by: list[str] = ()) -> DataFrame:
    return per_class.groupBy(*by).agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


#: Ranges that the distinct scores of a group are cut into, and the number of distinct scores from which a group is cut.
RANGES, CUT_FROM = 64, 10_000


def _ranged(h: DataFrame, score: str, counts: list[str], by: list[str]) -> DataFrame:
    """``h(by, score, counts)`` with ``_range``: each group's own scores cut at their quantiles, so no task holds all.

    The cuts come from a mergeable sketch (KLL) of the distinct scores of each group, over the very aggregate that is cut:
    both read one exchange, as the sketch's input mentions all its columns. Groups of few distinct scores aren't cut.
    """
    every = F.col(score).cast("double")
    for c in counts:
        every = F.when(F.col(c) >= 0, every)
    shares = F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)])
    sketches = h.groupBy(*by).agg(F.kll_sketch_agg_double(every).alias("_k"), F.count(F.lit(1)).alias("_d")).where(F.col("_d") > CUT_FROM)
    cuts = sketches.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.kll_sketch_get_quantile_double("_k", shares).alias("_cuts"))
    if by:
        x = h.join(cuts, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by], "left").drop(*[f"_by_{c}" for c in by])
    else:
        x = h.join(F.broadcast(cuts), F.lit(True), "left")  # one row at most
    return x.withColumn("_range", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(score).cast("double"))), F.lit(0))).drop("_cuts")


def running_totals(h: DataFrame, score: str, counts: list[str], by: list[str] = ()) -> DataFrame:
    """``h(by, score, counts)`` with ``_below_<count>``, the sum over the smaller scores of the group, and ``_all_<count>``,
    the group's sum. Scores are unique in a group; windows run within a range of them, and each range starts with the
    totals of those before it."""
    x, by = _ranged(h, score, counts, list(by)), list(by)
    totals = x.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in counts])
    group = Window.partitionBy(*by or [F.lit(0)])  # RANGES rows a group
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_at"), *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_s_{c}") for c in counts], *[F.sum(f"_t_{c}").over(group).alias(f"_all_{c}") for c in counts])
    on = [F.col("_range") == F.col("_at"), *[F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]]
    within = Window.partitionBy(*by, "_range").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = {f"_below_{c}": F.col(f"_s_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for c in counts}
    return x.join(starts, on).withColumns(below).drop("_range", "_at", *[f"_s_{c}" for c in counts], *[f"_by_{c}" for c in by])


def exact_percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, a column for each share): interpolated percentiles, exact, without holding a group's values in one buffer."""
    h = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    x = running_totals(h, "_v", ["_n"], by)
    at = {k: F.lit(p) * (F.col("_all__n") - 1) for k, p in shares.items()}
    holds = lambda place: (F.col("_below__n") <= place) & (place < F.col("_below__n") + F.col("_n"))
    ends = [F.max(F.when(holds(f(p)), F.col("_v"))).alias(f"_{e}_{k}") for k, p in at.items() for e, f in (("lo", F.floor), ("hi", F.ceil))]
    g = x.groupBy(*by).agg(*ends, F.max("_all__n").alias("_all__n"))
    return g.select(*by, *[(F.col(f"_lo_{k}") + (F.col(f"_hi_{k}") - F.col(f"_lo_{k}")) * (at[k] - F.floor(at[k]))).alias(k) for k in shares])


def auc_rank(df: DataFrame, positive: Column, score: str, by: list[str] = ()) -> DataFrame:
    """ROC AUC with ties at half, null for a single class. Scores are grouped first, so large groups combine before the
    shuffle, and ranks are running totals over ranges of distinct scores."""
    by = list(by)
    h = df.where(F.col(score).isNotNull() & positive.isNotNull()).groupBy(*by, F.col(score).alias("_s")).agg(F.count_if(positive).alias("_p"), F.count_if(~positive).alias("_n"))
    within = Window.partitionBy(*by, "_range").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    x = _ranged(h, "_s", ["_p", "_n"], by).withColumn("_w", F.col("_p") * (F.coalesce(F.sum("_n").over(within), F.lit(0)) + F.col("_n") / 2.0))
    # pairs within ranges, then each range's positives with the negatives of the ranges before it
    r = x.groupBy(*by, "_range").agg(F.sum("_w").alias("_w"), F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    before = Window.partitionBy(*by or [F.lit(0)]).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows a group
    r = r.withColumn("_w", F.col("_w") + F.col("_p") * F.coalesce(F.sum("_n").over(before), F.lit(0)))
    pairs = F.sum("_p").cast("double") * F.sum("_n")
    return r.groupBy(*by).agg(F.try_divide(F.sum("_w"), F.nullif(pairs, F.lit(0.0))).alias("auc"), F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"))


def roc_curve(df: DataFrame, positive: Column, score: str, by: list[str] = ()) -> DataFrame:
    """(threshold, tpr, fpr) per distinct score: shares of both classes at the threshold or over it."""
    h = df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("threshold")).agg(F.count_if(positive).alias("_p"), F.count_if(~positive).alias("_n"))
    x = running_totals(h, "threshold", ["_p", "_n"], by)
    rate = lambda c: F.try_divide((F.col(f"_all__{c}") - F.col(f"_below__{c}")).cast("double"), F.col(f"_all__{c}"))
    return x.select(*by, "threshold", rate("p").alias("tpr"), rate("n").alias("fpr"))


def youden_cutoff(curve: DataFrame, by: list[str] = ()) -> DataFrame:
    """Threshold of the largest tpr - fpr; the highest threshold on ties."""
    return curve.groupBy(*by).agg(F.max_by("threshold", F.struct(F.round(F.col("tpr") - F.col("fpr"), 12), "threshold")).alias("cutoff"), F.round(F.max(F.col("tpr") - F.col("fpr")), 12).alias("youden"))


def cutoff_metrics(df: DataFrame, positive: Column, score: str, cutoffs: list[float], by: list[str] = ()) -> DataFrame:
    """TP, FP, FN, TN and the rates at each cut-off (score at or over it counts as positive)."""
    x = df.where(F.col(score).isNotNull()).select(*by, positive.alias("_y"), F.col(score).alias("_s"), F.explode(F.array(*[F.lit(float(c)) for c in cutoffs])).alias("cutoff"))
    hit = F.col("_s") >= F.col("cutoff")
    g = x.groupBy(*by, "cutoff").agg(F.count_if(F.col("_y") & hit).alias("tp"), F.count_if(~F.col("_y") & hit).alias("fp"), F.count_if(F.col("_y") & ~hit).alias("fn"), F.count_if(~F.col("_y") & ~hit).alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    div = lambda a, b: F.try_divide(a, F.nullif(b, F.lit(0.0)))
    return g.withColumns({"sensitivity": div(tp, tp + fn), "specificity": div(tn, tn + fp), "precision": div(tp, tp + fp), "npv": div(tn, tn + fn), "f1": div(2 * tp, 2 * tp + fp + fn), "accuracy": div(tp + tn, tp + fp + fn + tn)})


def binary_agreement(df: DataFrame, a: str, b: str, classes: list[str]) -> DataFrame:
    """Two methods, class by class against the rest; a alone is fp, b alone is fn."""
    x = df.select(F.explode(F.array(*[F.lit(c) for c in classes])).alias("class"), (F.col(a)).alias("_a"), F.col(b).alias("_b"))
    pa, pb = F.coalesce(F.col("_a") == F.col("class"), F.lit(False)), F.coalesce(F.col("_b") == F.col("class"), F.lit(False))
    g = x.groupBy("class").agg(F.count_if(pa & pb).alias("tp"), F.count_if(~pa & ~pb).alias("tn"), F.count_if(pa & ~pb).alias("fp"), F.count_if(~pa & pb).alias("fn"))
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return g.withColumns({"agreement": F.try_divide(tp + tn, tp + tn + fp + fn), "precision": p, "recall": r, "f1": F.try_divide(2 * p * r, p + r)})


def disagreement_rows(df: DataFrame, a: str, b: str, classes: list[str]) -> DataFrame:
    """Rows where one method says a class and the other doesn't, once for each such class."""
    x = df.withColumn("class", F.explode(F.array(*[F.lit(c) for c in classes])))
    return x.where(F.coalesce(F.col(a) == F.col("class"), F.lit(False)) != F.coalesce(F.col(b) == F.col("class"), F.lit(False)))


def misclassified_rows(df: DataFrame, heads: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows with a head wrong, and a flag for each head."""
    flags = {f"{n}_wrong": F.coalesce(F.col(t) != F.col(p), F.lit(True)) for n, (t, p) in heads.items()}
    out = df.withColumns(flags)
    return out.where(" or ".join(flags))


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Kappa over rows with both labels; null for a single label."""
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    one = lambda c, k: x.groupBy(F.col(c).alias("l")).agg(F.sum("n").cast("double").alias(k))
    pe = one("a", "na").join(one("b", "nb"), "l", "full_outer").agg(F.sum(F.coalesce("na", F.lit(0.0)) * F.coalesce("nb", F.lit(0.0))).alias("s"), F.count("*").alias("k"))
    po = x.agg(F.sum("n").cast("double").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).cast("double").alias("same"))
    e, o = F.col("s") / (F.col("n") * F.col("n")), F.col("same") / F.col("n")
    return po.crossJoin(F.broadcast(pe)).select(F.when((F.col("n") > 1) & (F.col("k") > 1), F.try_divide(o - e, 1 - e)).alias("kappa"), o.alias("observed"), e.alias("expected"))


def facet_accuracy(df: DataFrame, correct: str, facets: list[str]) -> DataFrame:
    """(facet, value, correct, scored, accuracy) of every facet, from one unpivoted aggregation."""
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), F.coalesce(F.col(f).cast("string"), F.lit("?")).alias("value")) for f in facets])
    x = df.select(F.col(correct).alias("_c"), F.explode(pairs).alias("p")).groupBy("p.facet", "p.value")
    return x.agg(F.count_if(F.col("_c")).alias("correct"), F.count("_c").alias("scored")).withColumn("accuracy", F.try_divide(F.col("correct").cast("double"), F.col("scored")))


def transition_counts(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.groupBy(F.col(old).alias("source"), F.col(new).alias("target")).agg(F.count("*").alias("n")).withColumn("changed", ~F.col("source").eqNullSafe(F.col("target")))


def flow_nodes_links(df: DataFrame, old: str, new: str) -> DataFrame:
    """(source, target, n, source_index, target_index): links of a two-layer flow, nodes numbered in name order."""
    n = transition_counts(df, old, new)
    k = n.select("source").distinct().count()
    at = lambda c: F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(c)) - 1  # noqa: E731  over distinct pairs of labels
    return n.select("source", "target", "n", at("source").alias("source_index"), (at("target") + k).alias("target_index"))


def majority_vote(df: DataFrame, keys: list[str], label: str, position: str, failed: str = PARSE_FAILED) -> DataFrame:
    """Most frequent valid label; ties to the one met first; none: ``failed``."""
    votes = df.where((F.col(label) != failed) & F.col(label).isNotNull()).groupBy(*keys, F.col(label).alias("_l")).agg(F.count("*").alias("_n"), F.min(position).alias("_at"))
    best = votes.groupBy(*keys).agg(F.max_by("_l", F.struct(F.col("_n"), -F.col("_at"))).alias("vote"))
    return df.select(*keys).distinct().join(best, keys, "left").withColumn("vote", F.coalesce("vote", F.lit(failed)))


def aggregate_votes(df: DataFrame, keys: list[str], label: str, position: str, truth: str) -> DataFrame:
    """Vote of each group, its labels in order, and how many are correct."""
    runs = df.groupBy(*keys).agg(F.count("*").alias("n_items"), F.count_if(F.col(label) == F.col(truth)).alias("n_correct"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(label).alias("l")))), lambda x: x["l"]), ";").alias("labels"))
    return runs.join(majority_vote(df, keys, label, position), keys)


def unanimous_label(df: DataFrame, subject: str, label: str, several: str = "uncertain") -> DataFrame:
    return df.groupBy(subject).agg(F.when(F.count_distinct(label) == 1, F.min(label)).when(F.count_distinct(label) > 1, several).alias("label"))


def known_truth(df: DataFrame, keys: list[str], truth: str, position: str, unknown: str = "unknown") -> DataFrame:
    known = F.when(F.col(truth).isNotNull() & ~F.col(truth).isin("", unknown), F.struct(F.col(position), F.col(truth).alias("_t")))
    return df.groupBy(*keys).agg(F.coalesce(F.min(known)["_t"], F.lit(unknown)).alias("truth"))


def distinct_join(c: str, sep: str = ";") -> Column:
    """Aggregate: sorted distinct non-blank values joined."""
    return F.array_join(F.array_sort(F.collect_set(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")))), sep)


def with_percentiles(stats: DataFrame, df: DataFrame, by: list[str], columns: dict[str, tuple[str, float]]) -> DataFrame:
    """``stats(by, ...)`` with exact percentiles of ``df``: name -> (column, share)."""
    for name, (c, share) in columns.items():
        found = exact_percentiles(df, by, c, {name: share})
        found = found.select(*[F.col(b).alias(f"_by_{b}") for b in by], name)
        stats = stats.join(found, [F.col(b).eqNullSafe(F.col(f"_by_{b}")) for b in by] or F.lit(True), "left").drop(*[f"_by_{b}" for b in by])
    return stats


def group_stats(df: DataFrame, by: list[str], c: str, category: str | None = None, order: str | None = None, score: str | None = None) -> DataFrame:
    """(by, n, median, min, max) of ``c``; with ``category`` its value in the first row by ``order``, with ``score`` that
    column's median too. Medians are exact and hold no group in a buffer."""
    more = [F.min_by(category, order).alias("category")] if category else []
    stats = df.groupBy(*by).agg(F.count("*").alias("n"), F.min(c).alias("min"), F.max(c).alias("max"), *more)
    return with_percentiles(stats, df, by, {"median": (c, 0.5)} | ({"score_median": (score, 0.5)} if score else {}))


def five_number_summary(df: DataFrame, by: list[str], c: str) -> DataFrame:
    return exact_percentiles(df, by, c, {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0})


def metric_by_group(df: DataFrame, by: list[str], c: str, ratio: str | None = None) -> DataFrame:
    """(by, n, mean, median, std), and with ``ratio`` (a column such as predicted over true size) its mean and median."""
    more = [F.avg(ratio).alias("ratio_mean")] if ratio else []
    stats = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), *more)
    return with_percentiles(stats, df, by, {"median": (c, 0.5)} | ({"ratio_median": (ratio, 0.5)} if ratio else {}))


def distribution_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, min, p05, median, mean, p95, max) of many columns in one pass."""
    x = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    ends = x.groupBy("column").agg(F.min("v").alias("min"), F.avg("v").alias("mean"), F.max("v").alias("max"))
    return ends.join(exact_percentiles(x, ["column"], "v", {"p05": 0.05, "median": 0.5, "p95": 0.95}), "column", "left")


def histogram_bins(df: DataFrame, c: str, bins: int = 30) -> DataFrame:
    """(bin, n) of equal width between the extremes; the highest value is in the last bin. Equal values are one bin, 0."""
    ends = df.agg(F.min(c).cast("double").alias("_lo"), F.max(c).cast("double").alias("_hi"))
    share = F.coalesce(F.try_divide(F.col(c) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    at = F.least(F.floor(share * bins), F.lit(bins - 1))
    return df.where(F.col(c).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def subtotal_table(df: DataFrame, category: str, subtype: str, value: str) -> DataFrame:
    """Per (category, subtype) and per category (Total): n, share of the category, mean and deviation."""
    g = df.groupingSets([[category, subtype], [category]], category, subtype).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.grouping(subtype).alias("_t"))
    n = F.sum(F.when(F.col("_t") == 0, F.col("n"))).over(Window.partitionBy(category))
    return g.select(category, F.when(F.col("_t") == 1, "Total").otherwise(F.col(subtype)).alias(subtype), "n", F.round(F.col("n") * 100.0 / n, 2).alias("pct"), "mean", "std")


def top_value_share(df: DataFrame, by: list[str], c: str) -> DataFrame:
    """Most frequent value of a group (ties to the smaller) and its percent."""
    n = df.groupBy(*by, F.col(c).alias("_v")).agg(F.count("*").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy(*by))
    n = n.withColumn("pct", F.round(F.col("_n") * 100.0 / total, 2)).withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_n"), "_v")))
    return n.where("_rn = 1").select(*by, F.col("_v").alias("top"), "pct")


def topk_wide(df: DataFrame, by: list[str], label: str, k: int = 3) -> DataFrame:
    """Top labels and counts as columns, all instances and distinct labels; blanks where there are fewer."""
    n = df.groupBy(*by, F.col(label).alias("_l")).agg(F.count("*").alias("_n"))
    n = n.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_n"), "_l")))
    cols = [x for i in range(1, k + 1) for x in (F.coalesce(F.max(F.when(F.col("_rn") == i, F.col("_l"))), F.lit("")).alias(f"label_{i}"), F.coalesce(F.max(F.when(F.col("_rn") == i, F.col("_n"))), F.lit(0)).alias(f"count_{i}"))]
    return n.groupBy(*by).agg(*cols, F.sum("_n").alias("instances"), F.count("*").alias("unique_labels"))


def field_fill_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    one = df.agg(*[F.count_if(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "").alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in columns])).alias("x")).select("x.*")


def overlap_summary(df: DataFrame, known: DataFrame, batch: str, key: str) -> DataFrame:
    """Per batch: ids in all, known, new, and rows without an id."""
    k = known.select(F.col(key)).distinct().withColumn("_k", F.lit(True))
    x = df.join(k, key, "left")
    seen = F.col("_k").isNotNull()
    return x.groupBy(batch).agg(F.count_distinct(key).alias("total"), F.count_distinct(F.when(seen, F.col(key))).alias("known"), F.count_distinct(F.when(~seen, F.col(key))).alias("new"), F.count_if(F.col(key).isNull()).alias("no_id"))


def pairwise_auc(df: DataFrame, label: str, scores: dict[str, str], group: str, by: list[str] = ()) -> DataFrame:
    """Per class pair (and level of ``by``, such as a difficulty): AUC of the score difference over the rows of either
    class, its Hanley-McNeil error with half the number of groups as size, a 95 % interval, and whether that interval is
    over one half. Pairs of under 4 rows, or of one class, are left out."""
    names = sorted(scores)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    x = df.select(label, group, *by, F.explode(F.array(*[F.struct(F.lit(f"{a}|{b}").alias("pair"), F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col(scores[b]) - F.col(scores[a])).cast("double").alias("d")) for a, b in pairs])).alias("x")).select(label, group, *by, "x.*")
    x = x.where((F.col(label) == F.col("a")) | (F.col(label) == F.col("b")))
    keys = ["pair", *by]
    auc = auc_rank(x, F.col(label) == F.col("b"), "d", keys)
    sizes = x.groupBy(*keys).agg(F.count_distinct(group).alias("groups"), F.count("*").alias("rows"))
    a = F.col("auc")
    n = F.greatest(F.floor(F.col("groups") / 2), F.lit(2)).cast("double")
    q1, q2 = a / (2 - a), 2 * a * a / (1 + a)
    se = F.sqrt(F.greatest(a * (1 - a) + (n - 1) * (q1 + q2 - 2 * a * a), F.lit(0.0)) / (n * n))
    out = auc.join(sizes, keys).where("rows >= 4 and auc is not null").withColumn("se", se)
    out = out.select(*keys, "auc", "se", F.greatest(F.lit(0.0), a - 1.96 * F.col("se")).alias("low"), F.least(F.lit(1.0), a + 1.96 * F.col("se")).alias("high"), "groups")
    return out.withColumn("signal", F.col("low") > 0.5)


def poisson_steps(most: int = 8) -> list[tuple[int, int]]:
    """(limit, k): a number under 2^32 that is under the limit, and under no earlier one, is a Poisson(1) draw of k."""
    out, total, p = [], 0.0, math.exp(-1)
    for k in range(most):
        total += p
        out.append((int(total * 2**32), k))
        p /= k + 1
    return out


#: Tasks that a bootstrap deals sorted scores to, unless the session has more shuffle partitions.
BOOTSTRAP_TASKS = 16


def bootstrap_auc_ci(df: DataFrame, positive: Column, score: str, key: str, replicates: int = 200, seed: int = 0) -> DataFrame:
    """95 % percentile interval of AUC by a Poisson bootstrap whose weights come from seeded hashes of key and replicate.

    Rows are dealt out by score ranges (equal scores by key, so that a hot score is split) and each task draws a vector
    of weights per row, one entry a replicate. It returns three sums of vectors: of its first score, of its last, and of
    what lies between. One running total over these few rows, by score, gives all AUCs; no row meets each replicate.
    """
    x = df.where(F.col(score).isNotNull()).select(F.col(score).cast("double").alias("s"), F.coalesce(positive, F.lit(False)).alias("y"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.col(key).isNull().alias("none"))
    tasks = max(BOOTSTRAP_TASKS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = x.repartitionByRange(tasks, "s", F.xxhash64("k")).sortWithinPartitions("s")
    parts = dealt.mapInArrow(lambda batches: _bootstrap_part(batches, replicates, seed), "lo double, hi double, w array<double>, p array<double>, n array<double>")
    each = parts.select("lo", "hi", F.posexplode(F.arrays_zip("w", "p", "n")).alias("replicate", "v")).groupBy("replicate", "lo", "hi").agg(F.sum("v.w").alias("w"), F.sum("v.p").alias("p"), F.sum("v.n").alias("n"))
    each = each.withColumn("w", F.when(F.col("lo") == F.col("hi"), F.col("p") * F.col("n") / 2).otherwise(F.col("w")))  # a score that several tasks hold
    before = Window.partitionBy("replicate").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)  # three rows a task
    a = each.withColumn("w", F.col("w") + F.col("p") * F.coalesce(F.sum("n").over(before), F.lit(0.0))).groupBy("replicate")
    a = a.agg(F.try_divide(F.sum("w"), F.nullif(F.sum("p") * F.sum("n"), F.lit(0.0))).alias("auc"))
    return a.agg(F.percentile("auc", F.lit(0.025)).alias("low"), F.percentile("auc", F.lit(0.975)).alias("high"), F.count("auc").alias("replicates"))


def _bootstrap_part(batches: Iterator[pa.RecordBatch], replicates: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Sums over one task's rows, sorted by score: (lo, hi, pairs in order, positives, negatives), vectors by replicate."""
    limits = np.array([limit for limit, _ in poisson_steps()])
    heads = [hashlib.md5(f"{seed}:{r}".encode()) for r in range(replicates)]
    groups: list[list] = []  # [score, positives, negatives] of the first score, and of the one that is being read
    inner, low, high = np.zeros((3, replicates)), None, None

    def weights(keys: list[str], none: list[bool]) -> np.ndarray:
        raw = bytearray()
        for k, absent in zip(keys, none, strict=True):
            tail = b"" if absent else b":" + k.encode()
            for head in heads:
                h = head.copy()
                h.update(tail)
                raw += h.digest()[:4]
        return np.searchsorted(limits, np.frombuffer(raw, ">u4").astype(np.int64), "right").reshape(-1, replicates)

    def settle(group: list) -> None:
        nonlocal low, high
        inner[0] += group[1] * (inner[2] + group[2] / 2)
        inner[1] += group[1]
        inner[2] += group[2]
        low, high = group[0] if low is None else low, group[0]

    for batch in batches:
        scores, positive = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        names, none = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for at in range(0, len(scores), 4096):  # a weight matrix of bounded size
            part = slice(at, at + 4096)
            drawn = weights(names[part], none[part]).astype(float)
            now, last = scores[part][1:], scores[part][:-1]
            edges = np.flatnonzero(np.append(True, (now != last) & ~(np.isnan(now) & np.isnan(last))))
            p = np.add.reduceat(drawn * positive[part][:, None], edges)
            n = np.add.reduceat(drawn * ~positive[part][:, None], edges)
            for score, own_p, own_n in zip(scores[part][edges].tolist(), p, n, strict=True):
                if groups and (groups[-1][0] == score or score != score and groups[-1][0] != groups[-1][0]):  # NaN is a score, the highest
                    groups[-1][1], groups[-1][2] = groups[-1][1] + own_p, groups[-1][2] + own_n
                    continue
                if len(groups) == 2:
                    settle(groups.pop())
                groups.append([score, own_p, own_n])
    rows = [(g[0], g[0], np.zeros(replicates), g[1], g[2]) for g in groups]
    if low is not None:
        rows.append((low, math.nextafter(high, math.inf) if low == high else high, *inner))  # never taken for one score
    if rows:
        columns = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.float64()), pa.array(columns[1], pa.float64()), *[pa.array([v.tolist() for v in c], pa.list_(pa.float64())) for c in columns[2:]]], ["lo", "hi", "w", "p", "n"])


def accuracy_report(df: DataFrame, truth: str, pred: str, feature: str, images: str, failed: str = PARSE_FAILED, unknown: tuple[str, ...] = ("", "unknown")) -> DataFrame:
    """(section, value, n, accuracy, parse_failures) over rows with a known truth: overall, by feature, and by the number
    of images used (1, 2, 3-4 or 0; 3-4 takes all larger ones). A failed parse counts as wrong."""
    n = F.coalesce(F.col(images).try_cast("int"), F.lit(0))
    bucket = F.when(n == 1, "1").when(n == 2, "2").when(n >= 3, "3-4").otherwise("0")
    rows = df.where(~F.lower(F.trim(F.coalesce(F.col(truth).cast("string"), F.lit("")))).isin(*unknown))
    sections = F.array(*[F.struct(F.lit(k).alias("section"), v.cast("string").alias("value")) for k, v in (("overall", F.lit("")), ("feature", F.col(feature)), ("images", bucket))])
    x = rows.select(F.coalesce(F.col(truth).cast("string") == F.col(pred).cast("string"), F.lit(False)).alias("_ok"), (F.col(pred).cast("string") == failed).alias("_bad"), F.explode(sections).alias("x"))
    return x.groupBy("x.section", "x.value").agg(F.count("*").alias("n"), F.avg(F.col("_ok").cast("double")).alias("accuracy"), F.count_if("_bad").alias("parse_failures"))


def experiment_rollup(df: DataFrame, experiment: str, truth: str, pred: str, classes: list[str], failed: str = PARSE_FAILED) -> DataFrame:
    """A row per experiment over its parsed rows: n, n_unparsed, n_classes, chance, accuracy, macro_acc (mean over the
    classes that occur), acc_<class>, and the most frequent prediction with its share, ties to the first by name."""
    parsed = F.coalesce(F.col(pred).cast("string") != failed, F.lit(False))
    cell = df.groupBy(experiment, F.col(truth).cast("string").alias("_t"), F.when(parsed, F.col(pred).cast("string")).alias("_p")).agg(F.count("*").alias("_n"))
    ok, scored = F.when(F.col("_p") == F.col("_t"), F.col("_n")).otherwise(0), F.when(F.col("_p").isNotNull(), F.col("_n")).otherwise(0)
    per = cell.groupBy(experiment, "_t").agg(F.sum(ok).alias("_ok"), F.sum(scored).alias("_s"), F.sum("_n").alias("_n"))
    recall = F.try_divide(F.col("_ok").cast("double"), F.col("_s"))
    one = per.groupBy(experiment).agg(
        F.sum("_s").alias("n"), (F.sum("_n") - F.sum("_s")).alias("n_unparsed"), F.count_if(F.col("_s") > 0).alias("n_classes"), F.try_divide(F.lit(1.0), F.count_if(F.col("_s") > 0)).alias("chance"),
        F.try_divide(F.sum("_ok").cast("double"), F.sum("_s")).alias("accuracy"), F.avg(recall).alias("macro_acc"), *[F.max(F.when(F.col("_t") == c, recall)).alias(f"acc_{c}") for c in classes],
    )
    top = cell.where("_p is not null").groupBy(experiment, "_p").agg(F.sum("_n").alias("_n")).groupBy(experiment)
    top = top.agg(F.min(F.struct((-F.col("_n")).alias("k"), F.col("_p").alias("p"))).alias("_top"), F.sum("_n").alias("_all"))
    top = top.select(experiment, F.col("_top.p").alias("top_pred"), (-F.col("_top.k") / F.col("_all").cast("double")).alias("top_pred_frac"))
    return one.join(top, experiment, "left")


def backend_compare(df: DataFrame, backend: str, settings: list[str], deltas: list[str], components: str, rounder: tuple[str, float], smoother: tuple[str, float]) -> DataFrame:
    """A row per backend: n, mean, median and 10th percentile of dice, mean iou and hd95, ``delta_<k>`` (mean of pred_k
    less mean of gt_k), the share of fragmented predictions, ``smoothing`` (the delta of one measure over its limit, or
    that of the other below its limit), and ``mixed`` if its rows have several settings."""
    means = {k: F.avg(f"pred_{k}") - F.avg(f"gt_{k}") for k in deltas}
    g = df.groupBy(backend).agg(
        F.count("*").alias("n"), F.avg("dice").alias("dice"), F.avg("iou").alias("iou"), F.avg("hd95").alias("hd95"), *[v.alias(f"delta_{k}") for k, v in means.items()],
        F.avg((F.coalesce(F.col(components), F.lit(0)) > 1).cast("double")).alias("fragmented"), (F.count_distinct(F.struct(*settings)) > 1).alias("mixed"),
    )
    g = g.join(exact_percentiles(df, [backend], "dice", {"dice_median": 0.5, "dice_p10": 0.1}), backend, "left")
    return g.withColumn("smoothing", (F.col(f"delta_{rounder[0]}") > rounder[1]) | (F.col(f"delta_{smoother[0]}") < smoother[1]))


def coverage_report(resolved: DataFrame, feature: str, case: str, value: str) -> DataFrame:
    """(feature, cases, met_all, met_some, met_none) of :func:`~caseflow.operators.joins.resolve_requirements`' rows: how
    many cases have all, some but not all, or none of a feature's requirements."""
    per = resolved.groupBy(feature, case).agg(F.count("*").alias("_n"), F.count(value).alias("_k"))
    k, n = F.col("_k"), F.col("_n")
    return per.groupBy(feature).agg(F.count("*").alias("cases"), F.count_if(k == n).alias("met_all"), F.count_if((k > 0) & (k < n)).alias("met_some"), F.count_if(k == 0).alias("met_none"))


def label_vocabulary(values: DataFrame, feature: str, value: str) -> DataFrame:
    """(feature, options, multi_select): sorted distinct non-blank values of a JSON text column ``value`` that holds a
    scalar or a list; a feature is multi-select if any of its values is a list."""
    is_list = F.col(value).startswith("[")
    rows = values.select(feature, is_list.alias("_l"), F.explode_outer(F.when(is_list, F.from_json(value, "array<string>")).otherwise(F.array(value))).alias("_v"))
    return rows.groupBy(feature).agg(F.array_sort(F.collect_set(F.nullif(F.trim("_v"), F.lit("")))).alias("options"), F.coalesce(F.bool_or("_l"), F.lit(False)).alias("multi_select"))


def top_labels_by_facet(df: DataFrame, label: str, subject: str, facet: str, values: list[str], k: int = 6, left_out: tuple[str, ...] = ("localizer", "unknown", "")) -> DataFrame:
    """A row for each of the ``k`` labels of most subjects (ties by name), with the subjects for each facet value."""
    rows = df.where(~F.lower(F.coalesce(F.col(label), F.lit(""))).isin(*left_out))
    top = rows.groupBy(label).agg(F.count_distinct(subject).alias("subjects")).orderBy(F.desc("subjects"), label).limit(k)
    cells = rows.join(F.broadcast(top.select(label)), label, "left_semi").groupBy(label).agg(*[F.count_distinct(F.when(F.col(facet) == v, F.col(subject))).alias(v) for v in values])
    return top.join(cells, label)


def kept_excluded_counts(df: DataFrame, value: str, kept: Column) -> DataFrame:
    """(value, kept, excluded): rows of each value on either side, blanks as one empty value; a null rule excludes."""
    ok = F.coalesce(kept, F.lit(False))
    return df.groupBy(F.trim(F.coalesce(F.col(value).cast("string"), F.lit(""))).alias("value")).agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("excluded"))


def range_overlap_check(df: DataFrame, label: str, classes: list[str], descriptors: list[str], intended: set[str], defining: set[tuple[str, str, str]] = frozenset(), tolerance: float = 1e-6) -> DataFrame:
    """(descriptor, a, b, disjoint, shortcut) for each pair of declared classes with rows: whether the ranges don't
    meet, by a tolerance relative to the descriptor's largest end, and whether that is a shortcut: the descriptor is
    neither an intended one nor defines that pair. Pairs are those of the declared vocabulary."""
    x = df.where(F.col(label).isin(*classes)).select(label, F.explode(F.array(*[F.struct(F.lit(d).alias("descriptor"), F.col(d).cast("double").alias("v")) for d in descriptors])).alias("x")).select(label, "x.*")
    g = x.groupBy("descriptor", label).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    ends = g.groupBy("descriptor").agg(F.map_from_entries(F.collect_list(F.struct(label, F.struct("lo", "hi")))).alias("_e"), F.max(F.greatest(F.abs("lo"), F.abs("hi"))).alias("_m"))
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for i, a in enumerate(classes) for b in classes[i + 1 :]])
    e = ends.select("descriptor", "_e", "_m", F.explode(pairs).alias("p")).select("descriptor", "p.*", F.element_at("_e", F.col("p.a")).alias("_x"), F.element_at("_e", F.col("p.b")).alias("_y"), (F.nullif(F.col("_m"), F.lit(0.0))).alias("_m"))
    tol = F.coalesce("_m", F.lit(1.0)) * tolerance
    e = e.where("_x is not null and _y is not null").withColumn("disjoint", (F.col("_x.hi") < F.col("_y.lo") - tol) | (F.col("_y.hi") < F.col("_x.lo") - tol))
    allowed = F.col("descriptor").isin(*intended)
    for d, a, b in defining:
        allowed = allowed | ((F.col("descriptor") == d) & F.array_sort(F.array("a", "b")).eqNullSafe(F.array(*[F.lit(c) for c in sorted((a, b))])))
    return e.select("descriptor", "a", "b", "disjoint", (F.col("disjoint") & ~allowed).alias("shortcut"))


def geometry_mismatch(pairs: DataFrame, shape: tuple[str, str], affine: tuple[str, str], tolerance: float = 1e-3) -> DataFrame:
    """``pairs`` with ``geometry``: ``shape`` if an image's and its mask's shapes differ, ``affine`` if only their affines
    do by more than the tolerance, else ``ok``."""
    near = F.forall(F.zip_with(affine[0], affine[1], lambda x, y: F.coalesce(F.abs(x.cast("double") - y.cast("double")) <= tolerance, F.lit(False))), lambda ok: ok)
    return pairs.withColumn("geometry", F.when(~F.col(shape[0]).eqNullSafe(F.col(shape[1])), "shape").when(~F.coalesce(near, F.lit(False)), "affine").otherwise("ok"))


def reviewed_folder_flag(masks: DataFrame, folder: str, case: str, voxels: DataFrame | None = None) -> DataFrame:
    """(folder, reviewed): whether a folder has a mask; with a table of non-zero ``voxels`` by case, one that isn't empty."""
    if voxels is None:
        return masks.groupBy(folder).agg((F.count(case) > 0).alias("reviewed"))
    full = voxels.select(case).distinct().withColumn("_full", F.lit(True))
    return masks.join(full, case, "left").groupBy(folder).agg(F.coalesce(F.bool_or("_full"), F.lit(False)).alias("reviewed"))


def bvalue_summary(df: DataFrame, series: str, b_value: str) -> DataFrame:
    """(series, low, high, values): extremes and number of distinct b-values; any null makes the number 0."""
    return df.groupBy(series).agg(F.min(b_value).alias("low"), F.max(b_value).alias("high"), F.when(F.bool_or(F.col(b_value).isNull()), 0).otherwise(F.count_distinct(b_value)).alias("values"))
