"""Label rules and codings as one expression each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import alpha_tokens, blank_to_null, col, to_number, tokens_any

#: Words of scan descriptions that the rules look for.
GRE_WORDS = ("GRE", "GE", "SPGR", "FLASH", "FISP", "FIESTA", "TRUFI", "FFE", "VIBE", "LAVA")
SE_WORDS = ("SE", "FSE", "TSE", "HASTE", "RARE", "CPMG")
FATSAT_WORDS = ("STIR", "FS", "FATSAT", "FATSUPP", "SPIR", "SPAIR", "FLAIR", "FAT")
PHYSICS_FATSAT_WORDS = ("FS", "FATSAT", "FATSUPP", "SPIR", "SPAIR", "FAT", "CHEMSAT", "STIR")
AGENT_WORDS = ("YES", "Y", "GD", "CONTRASTE", "DOTAREM", "GADO", "GAD", "MH", "MULTIHANCE")


def first_rule(rules, default="") -> Column:
    """Value of the first (condition, value) whose condition holds."""
    out = None
    for when, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        when = F.coalesce(when, F.lit(False))
        out = F.when(when, value) if out is None else out.when(when, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def gre_flag(description, options) -> Column:
    """Gradient echo by the words of either text, unless a spin-echo word says otherwise."""
    return tokens_any(F.concat(alpha_tokens(description), alpha_tokens(options)), GRE_WORDS, SE_WORDS)


def keyword_label(description, options="", protocol="") -> Column:
    """Sequence type by ordered keywords; empty if none applies."""
    text = F.coalesce(col(description), F.lit(""))
    up, words = F.upper(text), alpha_tokens(text)
    options = col(options) if options != "" else F.lit("")
    protocol = F.coalesce(col(protocol), F.lit("")) if protocol != "" else F.lit("")
    t2 = F.when(gre_flag(text, options), "T2*").otherwise("T2W")
    return first_rule([
        (up.rlike("CAL|LOC|SCOUT|SURVEY"), "localizer"),
        (up.rlike("DWI|DIF|ADC"), "DWI"),
        (up.contains("PERFUSION"), "perfusion"),
        (up.rlike(r"\b(LAVA|FAME)\b"), "T1W"),
        (F.array_contains(words, "STIR"), "T2W"),
        (up.contains("T1"), "T1W"),
        (up.rlike(r"T2\*|\bMERGE\b"), "T2*"),
        (up.contains("T2") | up.contains("STIR") | protocol.contains("T2"), t2),
        (tokens_any(words, ("PDW", "DP", "PD")), "PD"),
    ])


def threshold_label(tr, te, gre) -> Column:
    """Sequence type by repetition and echo time (ms) where no keyword applies."""
    tr, te, gre = col(tr), col(te), col(gre)
    by_gradient = first_rule([(te < 10, F.when(tr < 600, "T1W").otherwise("PD")), (te > 15, F.when(tr > 1000, "T2*").otherwise("mixed"))], "PD")
    by_spin = first_rule([((te < 25) & (tr < 600), "T1W"), ((te < 25) & (tr > 1500), "PD"), ((te > 60) & (tr > 1500), "T2W")])
    return F.when(tr.isNull() | te.isNull(), "").when(gre, by_gradient).otherwise(by_spin)


def threshold_relabel(label, tr, te, gre, only: str = "PD") -> Column:
    """Rows labelled ``only`` labelled anew by their times; unparseable times keep the label."""
    tr, te = to_number(tr), to_number(te)
    fresh = first_rule([(te < 10, F.when(tr < 600, "T1W").otherwise("PD")), (te > 15, F.when(tr <= 1000, "mixed").when(col(gre), "T2*").otherwise("T2W"))], "PD")
    return F.when((col(label) == only) & tr.isNotNull() & te.isNotNull(), fresh).otherwise(col(label))


def fatsat_flag(description, options) -> Column:
    text = F.upper(F.coalesce(col(description), F.lit("")))
    return F.when(tokens_any(F.concat(alpha_tokens(description), alpha_tokens(options)), FATSAT_WORDS) | text.contains("STIR"), "fatsat").otherwise("")


def _named_contrast(description) -> Column:
    return tokens_any(alpha_tokens(description), ("GD", "GAD")) | F.upper(F.coalesce(col(description), F.lit(""))).rlike(r"\+C|\bCTE\b")


def contrast_flag(description, agent, dose) -> Column:
    """Contrast by description, by an agent with a dose, or by a known agent whose dose isn't 0."""
    agent, dose = F.coalesce(col(agent), F.lit("")), F.coalesce(col(dose), F.lit(""))
    given = (F.trim(agent) != "") & ~F.trim(dose).isin("", "0")
    known = tokens_any(alpha_tokens(agent), AGENT_WORDS) & (dose != "0")
    return F.when(_named_contrast(description) | given | known, "contrast").otherwise("")


def physics_label(df: DataFrame, tr="tr", te="te", ti="ti", etl="etl", flip="flip", field="field", description="description", options="options", scanning="scanning", agent="agent", dose="dose", image_type="image_type", b_value="b_value") -> DataFrame:
    """``df`` with sequence, acquisition, fat_sat and contrast by the decision tree of numeric scan parameters.

    Localizer words first; then diffusion, inversion recovery (TI over 0), gradient echo, spin echo. A value that is
    no number counts as missing. Parameters are parsed once, a branch is chosen, and the labels follow from it.
    """
    given, own = df.columns, "_"
    while any(c.startswith(own) for c in given):  # names that the caller's columns don't have
        own += "_"
    words = F.concat(alpha_tokens(description), alpha_tokens(options))
    up = F.upper(F.coalesce(col(description), F.lit("")))
    fat = tokens_any(words, PHYSICS_FATSAT_WORDS) | up.rlike(r"\bFAT[_\-]SAT\b") | F.upper(F.coalesce(col(options), F.lit(""))).rlike(r"\bFAT[_\-]SAT\b")
    agent, dose = F.trim(F.coalesce(col(agent), F.lit(""))), F.trim(F.coalesce(col(dose), F.lit("")))
    doses = (dose != "0") & ((agent != "") & ~F.upper(agent).isin("NONE", "NO", "0") | tokens_any(alpha_tokens(agent), AGENT_WORDS))
    numbers = {f"{own}tr": tr, f"{own}te": te, f"{own}ti": ti, f"{own}etl": etl, f"{own}fa": flip, f"{own}b0": field, f"{own}b": b_value}
    x = df.withColumns({
        **{k: to_number(v) for k, v in numbers.items()},
        f"{own}fs": F.when(fat, "FS").otherwise(""),
        f"{own}ce": F.when(_named_contrast(description) | doses, "Contrast").otherwise(""),
        f"{own}loc": up.rlike("CALI|LOC|SCOUT|SURVEY|ASSET"),
        f"{own}dwi": F.upper(F.coalesce(col(image_type), F.lit(""))).contains("DIFFUSION"),
        f"{own}gre": F.upper(F.coalesce(col(scanning), F.lit(""))).contains("GR"),
    })
    tr, te, ti, fa, b0 = (F.col(c) for c in (f"{own}tr", f"{own}te", f"{own}ti", f"{own}fa", f"{own}b0"))
    low, high, gradient = b0 < 2.0, b0 >= 2.0, F.col(f"{own}gre")
    x = x.withColumn(f"{own}k", first_rule([
        (F.col(f"{own}loc"), "localizer"),
        ((F.col(f"{own}b") > 0) | F.col(f"{own}dwi"), "diffusion"),
        ((ti > 0) & (low & ti.between(110, 190) | high & ti.between(150, 240)), "stir"),
        ((ti > 0) & (low & ti.between(1900, 2600) | high & ti.between(2400, 3200)), "flair"),
        ((ti > 0) & (te <= 30) & (tr < 4000), "inversion T1"),
        (ti > 0, "inversion"),
        (gradient & (tr.isNull() | te.isNull()), "gradient untimed"),
        (gradient & (tr <= 8) & (te <= 4) & fa.between(35, 100), "gradient localizer"),
        (gradient & (tr <= 20) & (te <= 6), "gradient T1"),
        (gradient & (te >= 6), "gradient T2"),
        (gradient, "gradient"),
    ], "spin"))
    k, echo = F.col(f"{own}k"), F.when(F.col(f"{own}etl") >= 2, "FSE").otherwise("SE")
    spin = F.when(tr.isNull() | te.isNull(), "Unknown").when(te <= 25, F.when(tr <= 1100, "T1W").otherwise("PD")).when((te >= 70) | (tr >= 1500), "T2W").otherwise("T1W")
    named = {"localizer": "Localizer", "gradient localizer": "Localizer", "diffusion": "DWI", "stir": "T2W", "flair": "T2W", "inversion T1": "T1W", "inversion": "Unknown", "gradient untimed": "Unknown_GRE", "gradient T1": "T1W", "gradient T2": "T2*", "gradient": "Unknown"}
    bare = k.isin("localizer", "gradient localizer")
    return x.select(
        *given,
        first_rule([(k == name, v) for name, v in named.items()], spin).alias("sequence"),
        first_rule([(k == "localizer", ""), (k.isin("diffusion", "spin"), echo), (k == "flair", "FLAIR"), (k.startswith("gradient"), "GRE")], "IR").alias("acquisition"),
        first_rule([(bare, ""), (k == "stir", "STIR")], F.col(f"{own}fs")).alias("fat_sat"),
        F.when(bare, "").otherwise(F.col(f"{own}ce")).alias("contrast"),
    )


def taxonomy_labels(fields, rules: list[tuple[str, str]]) -> Column:
    """struct(labels, source): classes whose pattern occurs in the first of ``fields`` where any does.

    ``rules`` lists (class, pattern); a class occurs once. Without a match labels is empty and source null.
    """
    found = [F.array_distinct(F.array_compact(F.array(*[F.when(col(f).rlike(p), F.lit(c)) for c, p in rules]))) for f in fields]
    out = None
    for name, labels in zip(fields, found, strict=True):
        hit = F.size(labels) > 0
        value = F.struct(labels.alias("labels"), F.lit(name).alias("source"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.struct(F.array().cast("array<string>").alias("labels"), F.lit(None).cast("string").alias("source")))


def first_two_labels(labels) -> Column:
    """struct(label1, label2, error): null where there is none; error if there are more than two."""
    x = col(labels)
    return F.struct(F.get(x, F.lit(0)).alias("label1"), F.get(x, F.lit(1)).alias("label2"), (F.size(x) > 2).alias("error"))


def composite_label(sequence, fat_sat, contrast, lookup: dict[tuple[str, bool, bool], str]) -> Column:
    """Label of (class, fat saturation, contrast) by lookup, else the parts joined by an underscore."""
    seq, fs, ce = col(sequence), col(fat_sat), col(contrast)
    return first_rule([((seq == s) & (fs == F.lit(f)) & (ce == F.lit(c)), v) for (s, f, c), v in lookup.items()], F.concat_ws("_", seq, F.when(fs, "FS"), F.when(ce, "CE")))


def cascade_label(w, fs, c) -> Column:
    """T1W with fat saturation and contrast, T2W with fat saturation, DWI; any other class as it is."""
    w, fs, c = col(w), col(fs), col(c)
    sat = F.when(fs.isin("Y", "Y-STIR"), "FS").otherwise("nFS")
    return F.when(w == "T1W", F.concat_ws("_", w, sat, F.when(c == "Y", "CE").otherwise("nCE"))).when(w == "T2W", F.concat_ws("_", w, sat)).when(w.isin("DW", "DWI"), "DWI").otherwise(w)


def modality_label(w, fs, c, fold: bool = False) -> Column:
    """``W-FS-C``; folded: STIR counts as fat saturation, and contrast counts for T1W only."""
    w, fs, c = col(w), col(fs), col(c)
    return F.concat_ws("-", w, F.when(fs == "Y-STIR", "Y").otherwise(fs), F.when(w == "T1W", c).otherwise("N")) if fold else F.concat_ws("-", w, fs, c)


def label_parts_join(*parts, sep: str = " ", empty: str = "Unlabeled") -> Column:
    """Non-blank parts joined; ``empty`` where the first is blank."""
    return F.when(blank_to_null(parts[0]).isNull(), empty).otherwise(F.concat_ws(sep, *[blank_to_null(p) for p in parts]))


def reference_status(label, reference) -> Column:
    """agree, disagree, or no data where the reference is blank."""
    ref = blank_to_null(reference)
    return F.when(ref.isNull(), "no data").when(F.lower(ref) == F.lower(F.trim(col(label))), "agree").otherwise("disagree")


def fold_values(c, table: dict[str, str]) -> Column:
    """Values replaced by a table, others kept."""
    return map_codes(c, table)


def map_codes(c, table: dict[str, str]) -> Column:
    return first_rule([(col(c) == k, v) for k, v in table.items()], col(c))


def decode_choice(c, table: dict[str, tuple[str, str, str]], keep) -> Column:
    """struct(w, fs, c) of a choice; one that isn't in the table keeps the given struct."""
    return first_rule([(col(c) == k, F.struct(F.lit(w).alias("w"), F.lit(fs).alias("fs"), F.lit(ce).alias("c"))) for k, (w, fs, ce) in table.items()], keep)


def to_yes_no(c, yes=None) -> Column:
    """Y if the value is in ``yes`` (without a list: if it isn't blank), else N."""
    hit = col(c).isin(*yes) if yes else blank_to_null(c).isNotNull()
    return F.when(hit, "Y").otherwise("N")


def translate_label(c, table: dict[str, str], several: str = "uncertain", missing: str | None = None) -> Column:
    """Comma: several; blank: missing; translated if known, else kept."""
    t = blank_to_null(c)
    return F.when(t.isNull(), F.lit(missing)).when(t.contains(","), several).otherwise(first_rule([(F.lower(t) == k.lower(), v) for k, v in table.items()], t))


def label_category(c, table: dict[str, str], unknown: str = "uncertain") -> Column:
    return first_rule([(col(c) == k, v) for k, v in table.items()], unknown)


def record_status(segmented, review) -> Column:
    """both, only_segmented, excluded, or null, from two columns of marks."""
    s, r = F.lower(F.trim(F.coalesce(col(segmented), F.lit("")))), F.lower(F.trim(F.coalesce(col(review), F.lit(""))))
    return F.when((s == "exclude") | (r == "exclude"), "excluded").when((s == "done") & (r == "done"), "both").when(s == "done", "only_segmented")


def count_bucket(c) -> Column:
    return F.when(col(c) >= 3, "3-4").when(col(c) == 2, "2").when(col(c) == 1, "1").otherwise("0")


def one_hot(c, values, prefix: str) -> list[Column]:
    """0/1 columns ``<prefix>_<value>`` for a declared vocabulary; null counts as no value."""
    return [F.coalesce((col(c) == v).cast("int"), F.lit(0)).alias(f"{prefix}_{v}") for v in values]


def one_hot_contains(c, values, prefix: str) -> list[Column]:
    """0/1 columns: a quoted part of the cell is a substring of the value. Empty parts match nothing."""
    parts = F.filter(F.transform(F.split(col(c), "'"), F.trim), lambda p: p != "")

    def inside(v: str):
        return lambda p: F.lit(v).contains(p)

    return [F.coalesce(F.exists(parts, inside(v)).cast("int"), F.lit(0)).alias(f"{prefix}_{v}") for v in values]


def or_columns(*flags) -> Column:
    return F.greatest(*[F.coalesce(col(f), F.lit(0)) for f in flags]) if len(flags) > 1 else col(flags[0])


def filled_zero(columns) -> Column:
    """struct(values..., filled): blank values as 0, and the names of those columns."""
    bad = [to_number(c).isNull() for c in columns]
    return F.struct(*[F.coalesce(to_number(c), F.lit(0.0)).alias(c) for c in columns], F.array_compact(F.array(*[F.when(b, F.lit(c)) for b, c in zip(bad, columns, strict=True)])).alias("filled"))


def manufacturer_norm(c, vendors: dict[str, str]) -> Column:
    """Canonical vendor by a contained word, else the text itself."""
    return first_rule([(F.lower(col(c)).contains(k), v) for k, v in vendors.items()], col(c))


def first_element_number(c) -> Column:
    """First number of a list-like cell such as ``[0.5, 0.5]`` or ``0.5\\0.5``."""
    return F.element_at(F.split(F.regexp_replace(col(c), r"[\[\]()'\s]", ""), r"[,\;]"), 1).try_cast("double")


def gender_code(c) -> Column:
    return F.when(col(c) == "M", "0").when(col(c) == "F", "1").otherwise(col(c))


def sex_decode(c) -> Column:
    return F.when(to_number(c) == 0, "Male").when(to_number(c) == 1, "Female").otherwise("Unknown")


def to_whole(c) -> Column:
    return to_number(c).try_cast("int")


def bti_size(c) -> Column:
    """Leading number of a size text such as ``35 mm``."""
    return F.nullif(F.regexp_extract(col(c), r"(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")


def describe_code(c, nouns: dict[str, str], marks: dict[str, str]) -> Column:
    """``T1W_C`` -> noun and described marks; an unknown code passes through."""
    parts = F.split(col(c), "_")
    noun = first_rule([(F.element_at(parts, 1) == k, v) for k, v in nouns.items()], F.lit(None).cast("string"))
    extra = F.array_compact(F.transform(F.slice(parts, 2, 9), lambda p: first_rule([(p == k, v) for k, v in marks.items()], F.lit(None).cast("string"))))
    return F.when(noun.isNull(), col(c)).when(F.size(extra) > 0, F.concat(noun, F.lit(" "), F.array_join(extra, " "))).otherwise(noun)


def build_context(**parts) -> Column:
    """Sentence of the parts that are present: ``name: value`` joined by ``; ``."""
    return F.concat_ws("; ", *[F.concat(F.lit(name.replace("_", " ") + ": "), blank_to_null(c)) for name, c in parts.items()])
