"""Column expressions on text, numbers, paths and dates. Names in, Columns out; no Python code runs on rows."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings that mean a missing value.
MISSING = ("", "nan", "none", "null")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_text(c, missing: str | None = "") -> Column:
    """Trimmed text; spellings of a missing value and null become ``missing`` (None: null)."""
    t = F.trim(col(c).cast("string"))
    return F.when(t.isNull() | F.lower(t).isin(*MISSING), F.lit(missing)).otherwise(t)


def is_present(c) -> Column:
    return ~F.coalesce(F.lower(F.trim(col(c).cast("string"))), F.lit("")).isin(*MISSING)


def blank_to_null(c) -> Column:
    return F.nullif(F.trim(col(c).cast("string")), F.lit(""))


def to_number(c) -> Column:
    """Number or null; never fails. Texts that can't begin a number aren't parsed: a failed parse costs an exception."""
    t = F.trim(col(c).cast("string"))
    return F.when(t.rlike(r"^[+-]?\.?\d"), t.try_cast("double"))


def alpha_tokens(c) -> Column:
    """Upper-case runs of the letters A-Z; a null text has none."""
    return F.array_remove(F.split(F.upper(F.coalesce(col(c), F.lit(""))), "[^A-Z]+"), "")


def tokens_any(c, words, unless=()) -> Column:
    """Whether a token is in ``words`` and none is in ``unless``."""
    t = alpha_tokens(c) if isinstance(c, str) else c
    found = F.arrays_overlap(t, F.array(*[F.lit(w) for w in words]))
    return found & ~F.arrays_overlap(t, F.array(*[F.lit(w) for w in unless])) if unless else found


def keyword_member(c, words) -> Column:
    """Whether the lower-case text contains a keyword."""
    low = F.lower(col(c))
    hit = F.lit(False)
    for w in words:
        hit = hit | low.contains(w)
    return hit


def extract_first(columns, pattern: str, group: int = 0) -> Column:
    """First match over several columns, in order; null if none matches."""
    return F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce(col(c), F.lit("")), pattern, group), F.lit("")) for c in columns])


def path_part(c, from_end: int) -> Column:
    """Path component counted from the end (1 is the last); null where there is none."""
    parts = F.split(col(c), "/")
    return F.when(F.size(parts) >= from_end, F.element_at(parts, -from_end))


def batch_of(c, prefix: str = "batch") -> Column:
    """First path part that begins with ``prefix``, else the parent folder, else null."""
    parts = F.split(col(c), "/")
    return F.coalesce(F.get(F.filter(parts, lambda p: F.lower(p).startswith(prefix)), F.lit(0)), F.when(F.size(parts) > 1, F.element_at(parts, -2)))


def remap_prefix(c, table: dict[str, str]) -> Column:
    """Path with its longest matching prefix replaced, at a ``/`` boundary only."""
    p, out = col(c), None
    for old in sorted(table, key=lambda x: (-len(x), x)):
        hit = (p == old) | p.startswith(old + "/")
        new = F.concat(F.lit(table[old]), F.substring(p, len(old) + 1, 1_000_000))
        out = F.when(hit, new) if out is None else out.when(hit, new)
    return p if out is None else out.otherwise(p)


def safe_token(c, fill: str = "-") -> Column:
    """Letters and digits kept, every other run one ``fill``, none at the ends."""
    return F.trim(F.regexp_replace(col(c), "[^A-Za-z0-9]+", fill)) if fill == " " else F.regexp_replace(F.regexp_replace(col(c), "[^A-Za-z0-9]+", fill), f"^{fill}+|{fill}+$", "")


def stable_uid(*columns) -> Column:
    """Deterministic id of its parts; a null part counts as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in columns]), 256)


def leading_number(c) -> Column:
    return F.nullif(F.regexp_extract(col(c), r"^(\d+)", 1), F.lit("")).cast("int")


def strip_leading_number(c) -> Column:
    return F.regexp_replace(col(c), r"^\d+[_\-\s]*", "")


def bvalue_from_name(c) -> Column:
    return F.nullif(F.regexp_extract(col(c), r"[bB](\d+)", 1), F.lit("")).cast("int")


def shots_from_name(c) -> Column:
    """``_fs_<n>`` gives n, ``_fs`` 0, anything else null."""
    n = F.nullif(F.regexp_extract(col(c), r"_fs_(\d+)", 1), F.lit("")).cast("int")
    return F.coalesce(n, F.when(col(c).rlike(r"_fs(_|$)"), F.lit(0)))


def date8(c) -> Column:
    """First eight-digit date in a name, or an ISO date without its dashes; null if neither."""
    eight = F.nullif(F.regexp_extract(col(c), r"(?<!\d)(\d{8})(?!\d)", 1), F.lit(""))
    return F.coalesce(eight, F.regexp_replace(F.nullif(F.regexp_extract(col(c), r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), "-", ""))


def age_years(born, at) -> Column:
    """Days between two dates over 365.25."""
    return F.datediff(col(at), col(born)) / F.lit(365.25)


def day_first(c) -> Column:
    """Date of a dd/MM/yyyy text, null if malformed."""
    return F.try_to_timestamp(col(c), F.lit("dd/MM/yyyy")).cast("date")


def human_bytes(c) -> Column:
    """Size with one decimal and the largest unit up to TB."""
    out = None
    for k, unit in reversed(list(enumerate(["B", "KB", "MB", "GB", "TB"]))):
        text = F.concat(F.format_string("%.1f", col(c).cast("double") / F.lit(float(1024**k))), F.lit(" " + unit))
        out = F.when(col(c) >= 1024**k, text) if out is None else out.when(col(c) >= 1024**k, text)
    return out.otherwise(F.concat(F.format_string("%.1f", col(c).cast("double")), F.lit(" B")))


def first_list_item(c, sep: str = ",") -> Column:
    return F.trim(F.split_part(col(c), F.lit(sep), F.lit(1)))


def location_text(*columns) -> Column:
    """Non-blank parts joined by a comma and a blank."""
    return F.concat_ws(", ", *[blank_to_null(c) for c in columns])


def remove_words(c, words) -> Column:
    """Text without the listed words, whatever their case; signs in a word stand for themselves."""
    plain = [re.sub(r"([^\w\s])", r"\\\1", w) for w in sorted(words, key=lambda w: (-len(w), w)) if w]
    return F.regexp_replace(col(c), "(?i)" + "|".join(plain), "") if plain else col(c)


def clean_tag_text(c) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), r"\*", "star"), "[^a-z0-9]", "")


def sibling_path(c, suffix: str = "_overlay") -> Column:
    """``stem.ext`` -> ``stem<suffix>.ext``; null without an extension."""
    return F.when(col(c).rlike(r"\.[^./]+$"), F.regexp_replace(col(c), r"^(.*)\.([^./]+)$", rf"$1{suffix}.$2"))
