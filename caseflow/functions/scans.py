"""Expressions on scan parameters, names and records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .reply import extract_json
from .text import blank_to_null, col, norm_text, to_number


def sequence_name(kind, fat_sat, contrast, volumes, b_values, low_b_values) -> Column:
    """Final name of a series from its class, flags, numbers of volumes and of b-values (in all, and under 800).

    A diffusion series that fits no rule has no name. T1W without contrast is always T1W-FS, as the rules have it.
    """
    k, fs, ce, v, b, low = (col(x) for x in (kind, fat_sat, contrast, volumes, b_values, low_b_values))
    many = (v > 1) & (b > 1)
    diffusion = F.when(many & (low > 4), "IVIM").when(many & (v > 16 * (b - 1) + 1), "DTI")
    t1 = F.when(ce & (v > 10), "DCE").when(ce & (v > 1), "T1W-CESC").when(ce, "T1W-CE").otherwise("T1W-FS")
    return F.when(k == "Other", "Other").when(k == "DW", diffusion).when(k == "T1W", t1).when(k == "T2W", F.when(fs, "T2W-FS").otherwise("T2W"))


def guess_from_name(c) -> Column:
    up = F.upper(col(c))
    return F.when(up.rlike(r"T2\*"), "T2*").when(up.contains("T1"), "T1").when(up.contains("T2"), "T2").when(up.rlike("DWI|DIFF|ADC"), "DWI").when(up.contains("PD"), "PD").otherwise("other")


def vendor_bvalue(fields, packed, name) -> Column:
    """Largest b-value of the vendors' fields; ``packed`` is backslash-separated and counts modulo 100000; with none,
    the one in the name."""
    from .text import bvalue_from_name

    first = F.element_at(F.split(col(packed), r"\\"), 1).try_cast("int") % 100000
    values = F.array_compact(F.array(*[to_number(f).try_cast("int") for f in fields], first))
    return F.coalesce(F.array_max(values), bvalue_from_name(name))


def orientation_text(cosines) -> Column:
    """struct(plane, letters): plane of the normal of the row and column directions, letters of their parts over 0.5."""
    v = [F.get(col(cosines), F.lit(k)) for k in range(6)]
    normal = F.array(*[F.abs(v[a] * v[b + 3] - v[b] * v[a + 3]) for a, b in ((1, 2), (2, 0), (0, 1))])
    plane = F.element_at(F.array(F.lit("Sagital"), F.lit("Coronal"), F.lit("Axial")), F.array_position(normal, F.array_max(normal)).cast("int"))
    letters = [F.when(F.abs(v[k]) > 0.5, F.when(v[k] > 0, "RAH"[k % 3]).otherwise("LPF"[k % 3])) for k in range(6)]
    return F.struct(plane.alias("plane"), F.concat_ws("", *letters).alias("letters"))


def sequence_family(tag, first, second) -> Column:
    return F.coalesce(col(tag), F.concat_ws(",", col(first), col(second)))


def age_prefix(c) -> Column:
    return F.substring(col(c), 1, 3)


def make_case_id(subject, session) -> Column:
    return F.when(blank_to_null(session).isNull(), col(subject).cast("string")).otherwise(F.concat_ws("/", col(subject).cast("string"), col(session).cast("string")))


def parse_file_name(c) -> Column:
    """struct(modality, plane, slice) of ``<modality>_<plane>_<n>``; parts are null where it doesn't fit."""
    at = lambda k: F.nullif(F.regexp_extract(col(c), r"^(.+)_(sagittal|coronal|axial)_(\d+)", k), F.lit(""))
    return F.struct(at(1).alias("modality"), at(2).alias("plane"), at(3).cast("int").alias("slice"))


def relative_id(c, root: str) -> Column:
    """Path under ``root`` without its suffix."""
    p = col(c)
    inside = F.when(p.startswith(root.rstrip("/") + "/"), F.substring(p, len(root.rstrip("/")) + 2, 1_000_000)).otherwise(p)
    return F.regexp_replace(inside, r"\.[^./]+$", "")


def compose_path(root: str, folder, *parts) -> Column:
    """root/folder/parts; null where the folder is unknown."""
    return F.when(col(folder).isNotNull(), F.concat_ws("/", F.lit(root), col(folder), *[col(p).cast("string") for p in parts]))


def repair_from_reply(features, reply, key: str) -> Column:
    """Map, overlaid by the last JSON object of the reply where its key field is blank."""
    f = F.coalesce(col(features), F.create_map().cast("map<string,string>"))
    found = F.coalesce(extract_json(reply), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(f, lambda k, _: ~F.map_contains_key(found, k))
    return F.when(blank_to_null(F.element_at(f, key)).isNull(), F.map_concat(kept, found)).otherwise(f)


def result_flatten(c) -> Column:
    """struct(uid, score, probability) of a nested JSON reply."""
    r = F.from_json(col(c), "uid string, result struct<score:int, probability:double>")
    return F.struct(r["uid"].alias("uid"), r["result"]["score"].alias("score"), r["result"]["probability"].alias("probability"))


def clinical_record(labels, **fields) -> Column:
    """struct of text fields with default Unknown, and the labels that aren't blank."""
    return F.struct(*[norm_text(c, "Unknown").alias(n) for n, c in fields.items()], F.array_compact(F.array(*[blank_to_null(x) for x in labels])).alias("labels"))


def vocabulary_minus(classes: list[str], skip: list[str]) -> list[str]:
    """Classes less those to skip; an unknown name, or fewer than two left, is an error."""
    unknown = [s for s in skip if s not in classes]
    kept = [c for c in classes if c not in skip]
    if unknown or len(kept) < 2:
        raise ValueError(f"unknown classes {unknown}" if unknown else "fewer than two classes are left")
    return kept
