"""Row selection: filters, dedupe, ranking, cohorts, folds and samples with explicit orders."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.reply import PARSE_FAILED
from .joins import first_per_key


def select_existing(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[n for n in names if n in df.columns])


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def reorder_columns(df: DataFrame, leading: list[str]) -> DataFrame:
    return df.select(*leading, *[c for c in df.columns if c not in leading])


def swap_columns(df: DataFrame, a: str, b: str) -> DataFrame:
    """Exchange two names at once."""
    return df.select(*[F.col(b).alias(a) if c == a else F.col(a).alias(b) if c == b else F.col(c) for c in df.columns])


def default_columns(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Add columns that are absent."""
    return df.withColumns({n: v for n, v in defaults.items() if n not in df.columns})


def exclude_values(df: DataFrame, c: str, values: list[str]) -> DataFrame:
    """Rows whose trimmed value isn't in the list; null counts as empty."""
    return df.where(~F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).isin(*values))


def required_nonblank(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "" for c in columns]))


def exclusion_flags(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """A flag per rule (null counts as false) and ``excluded``, their or."""
    flags = {n: F.coalesce(r, F.lit(False)) for n, r in rules.items()}
    return df.withColumns(flags).withColumn("excluded", reduce(lambda a, b: a | b, [F.col(n) for n in flags]))


def filter_reviewed(df: DataFrame, mark: str, value: str = "X") -> DataFrame:
    """Rows that carry the mark, whatever its case and the blanks around it."""
    return df.where(F.upper(F.trim(F.col(mark))) == value.upper())


def filter_scorable(df: DataFrame, truth: str, pred: str, failed: tuple[str, ...] = (PARSE_FAILED, "ERROR"), unknown: tuple[str, ...] = ("", "unknown")) -> DataFrame:
    """Rows with a known truth and a prediction that didn't fail; nulls are neither."""
    known = ~F.lower(F.trim(F.col(truth).cast("string"))).isin(*unknown)
    return df.where(known & ~F.col(pred).cast("string").isin(*failed))


def cascade_gate(df: DataFrame, truth: str, truths: list[str], pred: str, preds: list[str]) -> DataFrame:
    """Rows that a second stage really sees: their truth is in one set and the first stage's prediction in another."""
    return df.where(F.col(truth).isin(*truths) & F.col(pred).isin(*preds))


def tri_state_flag(df: DataFrame, key: str, members: DataFrame, name: str = "flag", blank: str = "") -> DataFrame:
    """``name``: Yes for keys among the members, No for others, ``blank`` for rows without a key (``Yes`` is a variant)."""
    own = members.select(F.col(key).alias("_m")).where(F.col("_m").isNotNull()).distinct()
    out = df.join(own, df[key] == own["_m"], "left")
    missing = F.trim(F.coalesce(df[key].cast("string"), F.lit(""))) == ""
    return out.withColumn(name, F.when(missing, blank).when(F.col("_m").isNotNull(), "Yes").otherwise("No")).drop("_m")


def facet_filter_page(df: DataFrame, truth: str, pred: str, tab: str, facets: dict[str, str], order: list, page: int, size: int, failed: str = PARSE_FAILED) -> DataFrame:
    """Page ``page`` (from 0) of a result tab: all, correct, wrong (parsed, but not the truth) or unparsed; ``facets``
    are column -> value, ``?`` for a blank one. Only a page's end is sorted for: pages are limits over an offset."""
    parsed = F.coalesce(F.col(pred) != failed, F.lit(False))
    right = F.coalesce(F.col(pred) == F.col(truth), F.lit(False))
    rows = df.where({"all": F.lit(True), "correct": parsed & right, "wrong": parsed & ~right, "unparsed": ~parsed}[tab])
    for c, v in facets.items():
        rows = rows.where(F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("?")) == v)
    return rows.orderBy(*order).limit((page + 1) * size).offset(page * size)


def pending_filter(df: DataFrame, combination: dict[str, str], viewed: str, pending: bool = True, second_review: bool = False, final: dict[str, str] | None = None, mark: str = "X") -> DataFrame:
    """Rows of a combination of predicted classes (``-`` stands for any) that aren't viewed yet; with ``second_review``
    the viewed ones whose final classes are all as in ``final``."""
    seen = F.coalesce(F.col(viewed) == mark, F.lit(False))
    if second_review:
        return df.where(reduce(lambda a, b: a & b, [F.col(c) == v for c, v in (final or {}).items()], seen))
    rows = df.where(reduce(lambda a, b: a & b, [F.col(c) == v for c, v in combination.items() if v != "-"], F.lit(True)))
    return rows.where(~seen) if pending else rows


def skip_named_scans(df: DataFrame, name: str, parts: list[str]) -> DataFrame:
    """Rows whose name holds none of the parts, whatever the case; rows without a name stay."""
    return df.where(~F.coalesce(F.col(name).rlike("(?i)" + "|".join(map(re.escape, parts))), F.lit(False)))


def value_or_default(df: DataFrame, c: str, default: str, name: str | None = None) -> DataFrame:
    """``name`` (or ``c``): the column's value, or the default where it is null or there is no such column."""
    found = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(default)) if c in df.columns else F.lit(default)
    return df.withColumn(name or c, found)


def active_labels(df: DataFrame, label: str, vocabularies: dict[str, list[str]], chosen: str | None = None) -> DataFrame:
    """(place, label, chance) of the labels that occur, in their vocabulary's order; chance is one over their number.

    Without a choice it is the first vocabulary that holds all labels which occur; none is an error. What reaches the
    driver is at most one label more than the vocabularies have.
    """
    most = sum(map(len, vocabularies.values())) + 1
    present = {r[0] for r in df.select(F.col(label).cast("string")).where(F.col(label).isNotNull()).distinct().limit(most).collect()}
    chosen = chosen or next((k for k, names in vocabularies.items() if present <= set(names)), None)
    names = [n for n in vocabularies.get(chosen, []) if n in present]
    if not names:
        raise ValueError(f"no vocabulary holds the labels {sorted(present)[:20]}")
    return df.sparkSession.createDataFrame([(k, n, 1.0 / len(names)) for k, n in enumerate(names)], "place int, label string, chance double")


def strided_shard(df: DataFrame, key: str, shards: int, shard: int) -> DataFrame:
    """Shard of a key by its hash: needs no order over all rows."""
    return df.where(hash_number(key, 0) % shards == shard)


def leakage_guard(df: DataFrame, exemplars: DataFrame, subject: str) -> DataFrame:
    """Drop every row of a subject that has an exemplar."""
    return df.join(exemplars.select(subject).distinct(), subject, "left_anti")


def dedupe_keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row of each key. Keys, which may be long texts, are compared by two hashes of 64 bits, so rows are sorted
    by numbers; the limit of one row a key is applied before the shuffle too."""
    hashed = df.withColumns({"_h": F.xxhash64(*keys), "_g": F.xxhash64(F.lit("dedupe"), *keys)})
    return first_per_key(hashed, ["_h", "_g"], order).drop("_h", "_g")


def latest_verdict(df: DataFrame, level: str, keys: dict[str, list[str]], order: list[str]) -> DataFrame:
    """Last row of each target, whose key depends on its level: ``keys`` maps a level to the columns of its key.

    Rows of other levels are left out. The result has ``target``, the key as text."""
    parts = lambda columns: F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    target = F.coalesce(*[F.when(F.col(level) == k, F.concat(F.lit(f"{k} "), parts(columns))) for k, columns in keys.items()])
    rows = df.withColumn("target", target).where("target is not null")
    last = F.max_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*order))
    return rows.groupBy("target").agg(last.alias("_r")).select("target", "_r.*")


def select_document(subjects: DataFrame, known: DataFrame, documents: DataFrame, subject: str, path: str, reviewed: str) -> DataFrame:
    """(subject, status, chosen, n_documents, n_reviewed, note): one document of each subject.

    ``known`` has the subjects that have a folder at all. A single document is taken; of several the only one that is
    reviewed; else the first by path, of the reviewed ones if there are any, which is ambiguous.
    """
    g = documents.groupBy(subject).agg(F.count("*").alias("n"), F.count_if(F.col(reviewed)).alias("r"), F.min(path).alias("_any"), F.min(F.when(F.col(reviewed), F.col(path))).alias("_own"))
    rows = subjects.select(subject).distinct().join(known.select(subject).distinct().withColumn("_k", F.lit(True)), subject, "left").join(g, subject, "left")
    n, r = F.coalesce("n", F.lit(0)), F.coalesce("r", F.lit(0))
    status = F.when(F.col("_k").isNull(), "subject_not_found").when(n == 0, "no_json").when(n == 1, "ok_single").when(r == 1, "ok_reviewed").otherwise("ok_ambiguous")
    note = (
        F.when(status == "subject_not_found", F.lit("no folder")).when(status == "no_json", F.lit("no document in any review"))
        .when(status == "ok_reviewed", F.concat(n.cast("string"), F.lit(" documents, the reviewed one taken")))
        .when(status == "ok_ambiguous", F.concat(F.when(r > 1, r).otherwise(n).cast("string"), F.when(r > 1, F.lit(" reviewed documents")).otherwise(F.lit(" documents, none reviewed")), F.lit(", the first by path taken")))
        .otherwise("")
    )
    chosen = F.when(F.col("_k").isNotNull(), F.when(r > 0, F.when(n > 1, F.col("_own")).otherwise(F.col("_any"))).otherwise(F.col("_any")))
    found = F.col("_k").isNotNull()
    return rows.select(subject, status.alias("status"), chosen.alias("chosen"), F.when(found, n).otherwise(0).alias("n_documents"), F.when(found, r).otherwise(0).alias("n_reviewed"), note.alias("note"))


def cohort_pool(labelled: DataFrame, imaged: DataFrame, excluded: DataFrame, subject: str, flags: dict[str, DataFrame]) -> DataFrame:
    """Labelled subjects with images that aren't excluded, a boolean ``has_<name>`` for each flag's members, and
    ``priority``, the number of flags that hold."""
    pool = labelled.join(imaged.select(subject), subject, "left_semi").join(excluded.select(subject), subject, "left_anti")
    for name, members in flags.items():
        own = members.select(subject).distinct().withColumn(f"has_{name}", F.lit(True))
        pool = pool.join(own, subject, "left").withColumn(f"has_{name}", F.coalesce(f"has_{name}", F.lit(False)))
    return pool.withColumn("priority", reduce(lambda a, b: a + b, [F.col(f"has_{n}").cast("int") for n in flags], F.lit(0)))


def sibling_values(df: DataFrame, group: list[str], value: str, position: str) -> DataFrame:
    """(group, value, others): for each distinct value of a group its other values, in the order in which they are first
    seen. Values are those of a vocabulary: their lists are short, whatever the group's rows."""
    once = df.groupBy(*group, value).agg(F.min(position).alias("_at"))
    run = once.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_at", value))).alias("_run"))
    values = F.transform("_run", lambda x: x[value])
    return run.select(*group, F.explode(values).alias(value), values.alias("_all")).select(*group, value, F.array_except("_all", F.array(value)).alias("others"))


#: Parts that a group is dealt to before its first rows are taken.
SALTS = 64


def top_per_group(df: DataFrame, group: list[str], order: list, k: int | Column) -> DataFrame:
    """First ``k`` rows of each group. With a number Spark limits each task's rows before the shuffle; with a column that
    tells it for each row, groups are first dealt to SALTS parts by a hash of the row, of which each keeps its first ``k``."""
    first = lambda x, by: x.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")
    if isinstance(k, int):
        return first(df, group)
    hashed = [F.col(f"`{c}`") for c, kind in df.dtypes if not kind.startswith("map")]
    return first(first(df.withColumn("_salt", F.pmod(F.xxhash64(*hashed), F.lit(SALTS))), [*group, "_salt"]).drop("_salt"), group)


def preview_with_rest(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """First ``k`` rows of each group, with ``more``: how many rows of the group aren't shown (negative: too few)."""
    n = df.groupBy(*group).agg((F.count(F.lit(1)) - k).alias("more")).select(*[F.col(c).alias(f"_by_{c}") for c in group], "more")
    shown = top_per_group(df, group, order, k)
    return shown.join(n, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in group]).drop(*[f"_by_{c}" for c in group])


def stratified_alloc(sizes: DataFrame, group: str, size: str, slots: int, least: int = 1) -> DataFrame:
    """(group, size, alloc): proportional slots, cut to whole numbers and to [min(size, least), size]; slots left over
    go to groups with most room, slots too many come from groups with most to spare; ties by group name.

    ``sizes`` has a row per group, so its windows are small.
    """
    every = Window.partitionBy(F.lit(0))
    s = sizes.withColumn("_pool", F.sum(size).over(every)).withColumn("_floor", F.least(F.col(size), F.lit(least)))
    s = s.withColumn("_a", F.least(F.greatest(F.coalesce(F.floor(F.try_divide(F.col(size) * F.lit(slots), F.col("_pool"))), F.lit(0)), F.col("_floor")), F.col(size)).cast("long"))
    s = s.withColumn("_d", F.least(F.lit(slots), F.col("_pool")) - F.sum("_a").over(every))
    s = s.withColumn("_room", F.col(size) - F.col("_a")).withColumn("_spare", F.col("_a") - F.col("_floor"))
    before = {n: F.coalesce(F.sum(n).over(Window.partitionBy(F.lit(0)).orderBy(F.desc(n), group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for n in ("_room", "_spare")}
    s = s.withColumn("_rb", before["_room"]).withColumn("_sb", before["_spare"])
    give = F.greatest(F.lit(0), F.least(F.col("_room"), F.col("_d") - F.col("_rb")))
    take = F.greatest(F.lit(0), F.least(F.col("_spare"), -F.col("_d") - F.col("_sb")))
    return s.select(group, size, (F.col("_a") + F.when(F.col("_d") > 0, give).otherwise(-take)).cast("long").alias("alloc"))


def even_split_alloc(sizes: DataFrame, group: str, size: str, target: int) -> DataFrame:
    """Every group its size or an equal, whole share of the target; what is left isn't dealt again."""
    k = F.count("*").over(Window.partitionBy(F.lit(0)))
    share = F.lit(float(target)) / k
    return sizes.select(group, size, F.when(F.col(size) <= share, F.col(size)).otherwise(F.floor(share)).cast("long").alias("alloc"))


#: Buckets that a hot group's order is dealt to.
RANK_BUCKETS = 256


def ranks(df: DataFrame, group: list[str], order: str, ties: list[str]) -> DataFrame:
    """``df`` with ``_rank``, from 1, of each row in its group by the text ``order`` (a hexadecimal hash, so its first digits
    deal rows out evenly) and then by ``ties``; no task holds a group.

    Rows are numbered within buckets of the order's first two digits; each bucket starts with the counts of those before.
    """
    x = df.withColumn("_bucket", F.conv(F.substring(order, 1, 2), 16, 10).cast("int"))
    counts = x.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group or [F.lit(0)]).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # RANK_BUCKETS rows a group
    starts = counts.select(*[F.col(c).alias(f"_by_{c}") for c in group], F.col("_bucket").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    on = [F.col("_bucket") == F.col("_at"), *[F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in group]]
    own = F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(order, *ties))
    return x.withColumn("_own", own).join(starts, on).withColumn("_rank", F.col("_start") + F.col("_own")).drop("_own", "_start", "_bucket", "_at", *[f"_by_{c}" for c in group])


def stratified_pick(pool: DataFrame, alloc: DataFrame, group: str, order: list) -> DataFrame:
    """The first ``alloc`` rows of each group; the planner broadcasts the allocation if it is small."""
    sized = pool.join(alloc.select(group, "alloc"), group)
    return top_per_group(sized, [group], order, F.col("alloc")).drop("alloc")


def shortfall_fill(pool: DataFrame, picked: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """Picked rows, and the first unpicked ones up to ``n`` in all."""
    left = pool.join(picked.select(key), key, "left_anti").withColumn("_p", F.lit(1))
    return picked.withColumn("_p", F.lit(0)).unionByName(left).orderBy("_p", *order).limit(n).drop("_p")


def hash_number(c: str, seed: int) -> Column:
    """Seeded whole number under 2^32 of a value."""
    return F.conv(F.substring(hash_rank(c, seed), 1, 8), 16, 10).cast("long")


def uniform(c: str, seed: int, draw: int) -> Column:
    """Seeded double in [0, 1) of a value: the ``draw``-th of a stream that doesn't depend on where rows lie."""
    text = F.concat_ws(":", F.lit(f"{seed}:{draw}"), F.col(c).cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def hash_rank(c: str, seed: int) -> Column:
    """Seeded order of values that doesn't depend on where rows lie."""
    return F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(c).cast("string")).cast("binary"))


def group_kfold(df: DataFrame, subject: str, folds: int, seed: int = 0) -> DataFrame:
    """``fold`` by subject: no subject is in two folds. Subjects are dealt by a seeded hash, without a global order."""
    return df.withColumn("fold", (hash_number(subject, seed) % folds).cast("int"))


def train_val_split(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """``part``: val for the given share of keys, by a seeded hash."""
    h = hash_number(key, seed) % 10_000
    return df.withColumn("part", F.when(h < int(share * 10_000), "val").otherwise("train"))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """At most ``n`` rows, the first by a seeded hash of the key."""
    return df.orderBy(hash_rank(key, seed), key).limit(n)


def balanced_assign(df: DataFrame, key: str, classes: list[str], within: str, seed: int = 0) -> DataFrame:
    """Class of each row of a group, dealt in turn in a seeded order; counts differ by one at most."""
    x = ranks(df.withColumn("_order", hash_rank(key, seed)), [within], "_order", [key])
    k = F.pmod(F.col("_rank") - 1, F.lit(len(classes)))
    return x.withColumn("class", F.element_at(F.array(*[F.lit(c) for c in classes]), (k + 1).cast("int"))).drop("_rank", "_order")


def exemplar_select(df: DataFrame, label: str, level: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows per class from its easiest (highest) level."""
    easiest = df.withColumn("_m", F.max(level).over(Window.partitionBy(label))).where(F.col(level) == F.col("_m")).drop("_m")
    return top_per_group(easiest, [label], [hash_rank(key, seed), key], n)


def exclusion_escalate(df: DataFrame, excluded: DataFrame, subject: str, date: str) -> DataFrame:
    """Rows whose (subject, date) isn't excluded; a subject with a single excluded row, or an exclusion without a
    date, is excluded whole."""
    n = df.groupBy(subject).agg(F.count("*").alias("_n"))
    whole = excluded.join(n, subject).where((F.col("_n") == 1) | F.col(date).isNull()).select(subject).distinct()
    return df.join(whole, subject, "left_anti").join(excluded.select(subject, date).distinct(), [subject, date], "left_anti")


def unique_case_id(df: DataFrame, subject: str, session: str, scan: str) -> DataFrame:
    """``case_id``: subject__scan, with the session appended on collision; exact repeats dropped."""
    once = df.dropDuplicates([subject, session, scan])
    k = F.row_number().over(Window.partitionBy(subject, scan).orderBy(session))
    base = F.concat_ws("__", F.col(subject).cast("string"), F.col(scan).cast("string"))
    return once.withColumn("case_id", F.when(k == 1, base).otherwise(F.concat_ws("__", base, F.col(session).cast("string"))))


def ordered_run(df: DataFrame, keys: list[str], position: str, item: str, declared: str) -> DataFrame:
    """Runs rebuilt in order: those without gaps in position whose size is the declared one, and their middle item."""
    runs = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("pos"), F.col(item).alias("item")))).alias("run"), F.max(declared).alias("_d"), F.count_if(F.col(position).isNull()).alias("_bad"))
    good = runs.where((F.col("_bad") == 0) & (F.size("run") == F.col("_d")))
    middle = F.element_at("run", (F.floor(F.size("run") / 2) + 1).cast("int"))["item"]
    return good.select(*keys, F.transform("run", lambda r: r["item"]).alias("items"), middle.alias("middle"))


def version_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, status, changed): copied, rerun with the names of changed fields, new, or dropped."""
    o = old.select(F.col(key), *[F.col(f).alias(f"_o_{f}") for f in fields], F.lit(True).alias("_o"))
    n = new.select(F.col(key), *[F.col(f).alias(f"_n_{f}") for f in fields], F.lit(True).alias("_n"))
    changed = F.array_compact(F.array(*[F.when(~F.col(f"_o_{f}").eqNullSafe(F.col(f"_n_{f}")), F.lit(f)) for f in fields]))
    status = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "dropped").when(F.size(changed) > 0, "rerun").otherwise("copied")
    both = F.col("_o").isNotNull() & F.col("_n").isNotNull()
    return o.join(n, key, "full_outer").select(key, status.alias("status"), F.when(both, F.array_join(changed, ";")).otherwise("").alias("changed"))
