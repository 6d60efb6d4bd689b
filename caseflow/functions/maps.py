"""JSON texts, literals, packed lists and boxes as maps, arrays and structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null, col


def parse_proba_map(c) -> Column:
    """JSON object of class -> probability; null if malformed."""
    return F.from_json(col(c), "map<string,double>")


def parse_literal_map(c) -> Column:
    """Map of a Python dict literal: its names of constants are rewritten where a value begins."""
    t = col(c)
    for name, value in (("None", "null"), ("True", "true"), ("False", "false")):
        t = F.regexp_replace(t, rf"([:,\[]\s*){name}\b", f"$1{value}")
    return F.from_json(t, "map<string,string>")


def parse_list_literal(c) -> Column:
    """Array of a list literal, else the text itself as the only element."""
    return F.coalesce(F.from_json(col(c), "array<string>"), F.array(col(c)))


def parse_kv_pairs(c) -> Column:
    """``k=v;k=v`` -> map."""
    return F.str_to_map(col(c), F.lit(";"), F.lit("="))


def parse_box(c) -> Column:
    """struct(r0, r1, c0, c1) of the first four integers of a text."""
    n = F.regexp_extract_all(col(c), F.lit(r"(-?\d+)"), F.lit(1))
    return F.when(F.size(n) >= 4, F.struct(*[F.get(n, F.lit(k)).cast("int").alias(x) for k, x in enumerate(("r0", "r1", "c0", "c1"))]))


def parse_margin(c) -> Column:
    """Pixels of ``=(r,c)px`` (the larger) or ``Npx``; null if neither."""
    pair = F.regexp_extract(col(c), r"=\((\d+),(\d+)\)px", 1)
    other = F.regexp_extract(col(c), r"=\((\d+),(\d+)\)px", 2)
    one = F.regexp_extract(col(c), r"(\d+)px", 1)
    return F.coalesce(F.greatest(F.nullif(pair, F.lit("")).cast("int"), F.nullif(other, F.lit("")).cast("int")), F.nullif(one, F.lit("")).cast("int"))


def lesion_fraction(extent, margin) -> Column:
    """(extent - 2 margins) / extent within 0.05 and 1; 0.5 where unknown."""
    e, m = col(extent).cast("double"), col(margin).cast("double")
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.05), F.try_divide(e - 2 * m, e))), F.lit(0.5))


def doc_feature_label(features, key: str, other: str) -> Column:
    """Value by a key or another one; lists joined by ``;``; ``unknown`` if empty."""
    raw = F.coalesce(blank_to_null(F.element_at(col(features), key)), blank_to_null(F.element_at(col(features), other)))
    return F.coalesce(F.array_join(F.from_json(raw, "array<string>"), ";"), raw, F.lit("unknown"))


def resolve_levels(c, presets: dict[str, float]) -> Column:
    """Comma list of preset names or numbers -> array of double; unknown entries are left out."""
    table = F.create_map(*[x for k, v in presets.items() for x in (F.lit(k), F.lit(v))])
    return F.array_compact(F.transform(F.split(col(c), ","), lambda p: F.coalesce(F.element_at(table, F.lower(F.trim(p))), F.trim(p).try_cast("double"))))


def request_map(**fields) -> Column:
    """Map of the fields that aren't blank."""
    pairs = F.map_from_arrays(F.array(*[F.lit(k) for k in fields]), F.array(*[F.coalesce(col(c).cast("string"), F.lit("")) for c in fields.values()]))
    return F.map_filter(pairs, lambda _, v: F.trim(v) != "")


def patch_map(features, patch) -> Column:
    """Map with the patch's fields put over its own; a null patch changes nothing."""
    f, p = col(features), F.coalesce(col(patch), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(f, lambda k, _: ~F.map_contains_key(p, k))
    return F.map_concat(kept, p)
