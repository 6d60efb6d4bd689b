"""Joins, look-ups and merges with explicit semantics for duplicates, blanks and ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first in an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def join_methods_inner(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b, keys, "inner")


def matched_counts(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row (n_a, n_b, matched): rows of either method, and pairs that their keys match."""
    one = a.groupBy(*keys).agg(F.count("*").alias("_a"))
    two = b.groupBy(*keys).agg(F.count("*").alias("_b"))
    both = one.join(two, keys, "full_outer").select(F.coalesce("_a", F.lit(0)).alias("_a"), F.coalesce("_b", F.lit(0)).alias("_b"))
    return both.agg(F.sum("_a").alias("n_a"), F.sum("_b").alias("n_b"), F.sum(F.col("_a") * F.col("_b")).alias("matched"))


def join_left_reference(df: DataFrame, reference: DataFrame | None, keys: list[str], columns: list[str], renamed: dict[str, str] | None = None) -> DataFrame:
    """``columns`` of a reference attached by whichever of ``keys`` both sides have; old columns of these names go.

    ``renamed`` maps the reference's names first. Columns that the reference lacks, and all of them without a reference
    or a common key, are empty text; rows without a match have nulls.
    """
    out = df.drop(*columns)
    if reference is not None:
        reference = reference.withColumnsRenamed(renamed or {})
        common = [k for k in keys if k in out.columns and k in reference.columns]
        if common:
            out = out.join(reference.select(*common, *[c for c in columns if c in reference.columns]), common, "left")
    return out.withColumns({c: F.lit("") for c in columns if c not in out.columns})


def plane_fallback(rows: DataFrame, lookup_table: DataFrame, keys: list[str], plane: str, computed: Column, unknown: str = "unknown") -> DataFrame:
    """``plane`` from the look-up table unless it is unknown or absent there, else as computed, else unknown."""
    table = lookup_table.select(*keys, F.trim(plane).alias("_p"))
    known = F.when(~F.col("_p").isin("", unknown), F.col("_p"))
    return rows.join(table, keys, "left").withColumn(plane, F.coalesce(known, computed, F.lit(unknown))).drop("_p")


def merge_clinical_fields(rows: DataFrame, record: DataFrame, case_id: str, subject: str, columns: list[str]) -> DataFrame:
    """Clinical columns by subject, which is the case id before its first ``/``; cases without a record have nulls."""
    keyed = rows.withColumn("_subject", F.split_part(F.col(case_id).cast("string"), F.lit("/"), F.lit(1)))
    fields = record.select(F.col(subject).cast("string").alias("_subject"), *columns)
    return keyed.join(first_per_key(fields, ["_subject"], columns), "_subject", "left").drop("_subject")


def exemplar_validate(exemplars: DataFrame, options: list[str], label: str = "label", path: str = "path", base: str = "") -> DataFrame:
    """Exemplars with labels in the options' spelling and paths under ``base`` unless they are absolute.

    Fails, when it runs, on a label that isn't an option and on an exemplar without a path.
    """
    given = F.trim(F.coalesce(F.col(label).cast("string"), F.lit("")))
    spelled = F.element_at(F.create_map(*[x for o in options for x in (F.lit(o.lower()), F.lit(o))]), F.lower(given))
    file = F.trim(F.coalesce(F.col(path), F.lit("")))
    full = F.when(file.startswith("/"), file).otherwise(F.concat(F.lit(f"{base.rstrip('/')}/"), file)) if base else file
    fail = lambda what, c: F.raise_error(F.concat(F.lit(what), c))
    checked = F.when(file == "", fail("exemplar without a path, label ", given)).otherwise(F.coalesce(spelled, fail(f"not in {options}: ", given)))
    return exemplars.withColumns({label: checked, path: full})


def join_left_one_to_one(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that fails, when it runs, if a key occurs twice on either side."""
    once = [d.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))) for d in (a, b)]
    checked = [d.where(F.when(F.col("_n") > 1, F.raise_error(F.lit(f"duplicate keys {keys}")).cast("boolean")).otherwise(True)).drop("_n") for d in once]
    return checked[0].join(checked[1], keys, "left")


def join_left_first_match(a: DataFrame, b: DataFrame, keys: list[str], order: list) -> DataFrame:
    return a.join(first_per_key(b, keys, order), keys, "left")


def join_outer_coalesce_key(a: DataFrame, b: DataFrame, a_key: str, b_key: str, key: str) -> DataFrame:
    joined = a.join(b, a[a_key] == b[b_key], "full_outer")
    rest = [a[c] for c in a.columns if c != a_key] + [b[c] for c in b.columns if c != b_key]
    return joined.select(F.coalesce(a[a_key], b[b_key]).alias(key), *rest)


def join_inner_renamed_key(a: DataFrame, b: DataFrame, a_key: str, b_key: str) -> DataFrame:
    return a.join(b, a[a_key] == b[b_key]).drop(b[b_key])


def semi_members(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b.select(*keys), keys, "left_semi")


def anti_members(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't known; rows with a null key stay."""
    return a.join(b.select(*keys), keys, "left_anti")


def lookup(a: DataFrame, table: DataFrame, key: str, value: str, default: Column | None = None) -> DataFrame:
    """``value`` looked up by ``key``; a miss keeps the default."""
    out = a.join(table.select(key, value), key, "left")
    return out if default is None else out.withColumn(value, F.coalesce(F.col(value), default))


def two_runs(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Inner join of two runs, the value suffixed by run."""
    return a.select(*keys, F.col(value).alias(f"{value}_a")).join(b.select(*keys, F.col(value).alias(f"{value}_b")), keys)


def merge_with_conflicts(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """New value where present, else the old one; ``conflict`` where both are present and differ."""
    new = b.select(key, F.col(value).alias("_new"))
    out = a.join(new, key, "left")
    return out.withColumn("conflict", F.coalesce((F.col("_new") != F.col(value)), F.lit(False))).withColumn(value, F.coalesce("_new", value)).drop("_new")


def patch_overrides(a: DataFrame, fixes: DataFrame, key: str, value: str) -> DataFrame:
    """Corrections by key, blank ones ignored; the old value stays in ``<value>_orig``."""
    fix = fixes.where(F.trim(F.coalesce(F.col(value), F.lit(""))) != "").select(key, F.col(value).alias("_fix"))
    out = a.join(fix, key, "left")
    return out.withColumn(f"{value}_orig", F.col(value)).withColumn(value, F.coalesce("_fix", value)).drop("_fix")


def merge_selections(new: DataFrame, old: DataFrame, key: str, value: str, old_mark_wins: str | None = None) -> DataFrame:
    """Blank new values keep the earlier ones; an earlier mark can be made to win always."""
    out = new.join(old.select(key, F.col(value).alias("_old")), key, "left")
    fresh = F.coalesce(F.nullif(F.col(value), F.lit("")), F.col("_old"))
    return out.withColumn(value, F.when(F.col("_old") == old_mark_wins, F.col("_old")).otherwise(fresh) if old_mark_wins else fresh).drop("_old")


def fill_from_manual(a: DataFrame, manual: DataFrame, key: str, value: str, text: str) -> DataFrame:
    """Missing numbers filled by hand entries; rows with a hand entry that is no number are dropped."""
    given = manual.select(key, F.col(text).alias("_t"), F.col(text).try_cast("double").alias("_v"))
    out = a.join(given, key, "left").where(F.col("_t").isNull() | F.col("_v").isNotNull())
    return out.withColumn(value, F.coalesce(F.col(value).cast("double"), F.col("_v"))).drop("_t", "_v")


def nearest_date_join(rows: DataFrame, sessions: DataFrame, subject: str, row_id: str, row_date: str, session: str, session_date: str, counts: list[str]) -> DataFrame:
    """Each session goes to its subject's row of the nearest date; ties, and sessions without a date, to the first
    row. Counts add up; the last session's name in order is kept. Rows without sessions have null counts."""
    day = lambda c: F.col(c).cast("date").alias("_date")
    dated = rows.where(F.col(row_date).isNotNull()).groupBy(subject, day(row_date)).agg(F.min(row_id).alias("_id"))
    first = rows.groupBy(subject).agg(F.min(row_id).alias("_first"))
    # one line of days for each subject, of as many rows as there are days, however many rows and sessions it has: the
    # nearest rows are those of the last day before and the first day after
    asked = sessions.where(F.col(session_date).isNotNull()).select(subject, day(session_date)).distinct().withColumn("_asks", F.lit(True))
    line = dated.unionByName(asked, allowMissingColumns=True).groupBy(subject, "_date").agg(F.max("_id").alias("_id"), F.max("_asks").alias("_asks"))
    w = Window.partitionBy(subject).orderBy("_date")
    place = F.when(F.col("_id").isNotNull(), F.struct("_date", "_id"))
    line = line.withColumn("_before", F.last(place, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    line = line.withColumn("_after", F.first(place, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))).where("_asks")
    near = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.abs(F.datediff("_date", F.col(c)["_date"])).alias("gap"), F.col(c)["_id"].alias("id"))) for c in ("_before", "_after")]))
    line = line.select(subject, "_date", F.array_min(near).alias("_near"))
    found = sessions.select(subject, session, *counts, day(session_date)).join(line, [subject, "_date"], "left").join(first, subject)
    gap, nearest = F.col("_near")["gap"], F.coalesce(F.col("_near")["id"], F.col("_first"))
    best = found.groupBy(subject, session).agg(F.min(F.struct(gap.isNull().alias("none"), gap.alias("gap"), nearest.alias("_row"), *counts)).alias("_v"))
    hits = best.select(session, F.col("_v._row").alias(row_id), *[f"_v.{c}" for c in counts]).groupBy(row_id).agg(*[F.sum(c).alias(c) for c in counts], F.max(session).alias(session))
    return rows.join(hits, row_id, "left")


def reconcile(record: DataFrame, disk: DataFrame, key: str, recorded: str, found: str) -> DataFrame:
    """Every key of either side with its class: agree, recorded_only, disk_only, or unrecorded_mark."""
    r, d = record.select(key, F.col(recorded).alias("_r")), disk.select(key, F.col(found).alias("_d"))
    r_has, d_has = F.coalesce("_r", F.lit(False)), F.coalesce("_d", F.lit(False))
    kind = F.when(r_has & ~d_has, "recorded_only").when(~r_has & d_has & F.col("_r").isNull(), "unrecorded_mark").when(~r_has & d_has, "disk_only").otherwise("agree")
    return r.join(d, key, "full_outer").select(key, kind.alias("status"))


def resolve_requirements(cases: DataFrame, needs: DataFrame, available: DataFrame, case: str, on: list[str], value: str) -> DataFrame:
    """Every case with every requirement and what is available for it, or null.

    Requirements are a configuration: they become an array of literals, which fails on more than a thousand of them."""
    given = [r.asDict() for r in needs.select(*on).distinct().limit(1001).collect()]
    if len(given) > 1000:
        raise ValueError("more than 1000 requirements")
    types = {f.name: f.dataType for f in needs.schema.fields}
    every = F.array(*[F.struct(*[F.lit(r[c]).cast(types[c]).alias(c) for c in on]) for r in given])
    wanted = cases.select(case).distinct().withColumn("_need", F.explode(every)).select(case, "_need.*")
    return wanted.join(available.select(case, *on, value), [case, *on], "left")


def overlay_or_plain(rows: DataFrame, inventory: DataFrame, path: str, sibling: Column, run: list[str] | None = None) -> DataFrame:
    """Path of the sibling if the inventory has it, with ``has_contour``; with ``run``, the columns that tell a run (none:
    all rows are one), also ``run_has_contour``: whether all items of the run have it."""
    have = inventory.select(F.col(path).alias("_p")).distinct()
    out = rows.withColumn("_s", sibling).join(have, F.col("_s") == F.col("_p"), "left")
    out = out.withColumn("has_contour", F.col("_p").isNotNull()).withColumn(path, F.coalesce("_p", path)).drop("_s", "_p")
    if run is None:
        return out
    every = out.groupBy(*run).agg(F.every("has_contour").alias("run_has_contour"))
    return out.join(every, run) if run else out.crossJoin(F.broadcast(every))  # one row


def path_suffix_match(recorded: DataFrame, inventory: DataFrame, path: str, parts: tuple[int, ...] = (3, 2, 1)) -> DataFrame:
    """Recorded paths resolved by their last 3, 2 or 1 parts; the longest match wins, then the first path."""
    def tails(df: DataFrame, name: str) -> DataFrame:
        split = F.split(F.col(path), "/")
        keys = F.array(*[F.when(F.size(split) >= k, F.struct(F.lit(k).alias("k"), F.array_join(F.slice(split, -k, k), "/").alias("tail"))) for k in parts])
        return df.select(F.col(path).alias(name), F.explode(F.array_compact(keys)).alias("_t")).select(name, "_t.*")

    hits = tails(recorded.select(path).distinct(), path).join(tails(inventory.select(path).distinct(), "found"), ["k", "tail"])
    best = first_per_key(hits, [path], [F.desc("k"), "found"]).select(path, "found")
    return recorded.join(best, path, "left")
