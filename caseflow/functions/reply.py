"""Model replies: thinking, JSON, answers and rankings parsed by expressions on one text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import blank_to_null, col

#: Markers of the replies, and the label of a reply without an answer.
THINK_STARTS, THINK_ENDS, TURN_END = ("<unused94>", "<think>"), ("<unused95>", "</think>"), "<end_of_turn>"
PARSE_FAILED = "PARSE_FAILED"


def _any(text: Column, marks) -> Column:
    hit = F.lit(False)
    for m in marks:
        hit = hit | text.contains(m)
    return hit


def was_truncated(reply) -> Column:
    """Thinking began and never ended."""
    t = F.coalesce(col(reply), F.lit(""))
    return _any(t, THINK_STARTS) & ~_any(t, THINK_ENDS)


def answer_region(reply) -> Column:
    """Text after the last end of thinking, up to the end of the turn; empty if truncated."""
    t = F.coalesce(col(reply), F.lit(""))
    for m in THINK_ENDS:
        t = F.substring_index(t, m, -1)
    return F.when(was_truncated(reply), "").otherwise(F.trim(F.substring_index(t, TURN_END, 1)))


def extract_thinking(reply) -> Column:
    """Text between the markers, without a leading word ``thought``; null without markers."""
    t = F.nullif(F.regexp_extract(col(reply), r"(?s)(?:<unused94>|<think>)(.*?)(?:<unused95>|</think>|$)", 1), F.lit(""))
    return F.trim(F.regexp_replace(t, r"^\s*thought\s*", ""))


def json_in(region) -> Column:
    """Last fenced chunk, else last flat object, of an answer that parses; a map of strings, or null."""
    region = col(region)
    fenced = F.regexp_extract_all(region, F.lit(r"(?s)```(?:json)?\s*(\{.*?\})\s*```"), F.lit(1))
    flat = F.regexp_extract_all(region, F.lit(r"(\{[^{}]*\})"), F.lit(1))

    def last(chunks: Column) -> Column:
        parsed = F.filter(F.transform(chunks, lambda c: F.from_json(c, "map<string,string>")), lambda m: m.isNotNull() & (F.size(m) > 0))
        return F.get(F.reverse(parsed), F.lit(0))

    return F.when(region.contains("{"), F.coalesce(last(fenced), last(flat)))


def extract_json(reply) -> Column:
    """The object of :func:`json_in` in the reply's answer."""
    return json_in(answer_region(reply))


def canonical(value, options) -> Column:
    """The option equal to ``value`` but for case, as the options spell it; null if none is."""
    low = F.lower(F.trim(col(value)))
    return F.get(F.filter(col(options), lambda o: F.lower(o) == low), F.lit(0))


def parse_answers(df: DataFrame, reply: str, options, key: str = "answer") -> DataFrame:
    """``df`` with label and reason: from JSON, else a loose key, else the only option word present, else PARSE_FAILED.

    The answer's region and its JSON are computed once, and later steps only where the earlier ones found nothing.
    """
    given = df.columns
    x = df.withColumn("_options", options if isinstance(options, Column) else F.col(options)).withColumn("_region", answer_region(reply))
    x = x.withColumn("_found", json_in("_region"))
    x = x.withColumn("_label", canonical(F.element_at("_found", key), "_options"))
    loose = F.regexp_extract(F.col("_region"), rf'(?i)"?{key}"?\s*[:=]\s*"?([^",\n}}]+)', 1)
    x = x.withColumn("_label", F.when(F.col("_label").isNull(), canonical(loose, "_options")).otherwise(F.col("_label")))
    words = F.split(F.lower(F.translate(F.col("_region"), '.,"', "   ")), r"\s+")
    x = x.withColumn("_present", F.when(F.col("_label").isNull(), F.filter(F.col("_options"), lambda o: F.array_contains(words, F.lower(o)))))
    label = F.coalesce("_label", F.when(F.size("_present") == 1, F.get("_present", F.lit(0))), F.lit(PARSE_FAILED))
    return x.select(*given, label.alias("label"), F.coalesce(F.element_at("_found", "reason"), F.lit("")).alias("reason"))


def parse_ranking(reply, options) -> Column:
    """struct(ranking, label): the last line that ranks every option once; a tie at the top is PARSE_FAILED."""
    lines = F.split(F.lower(answer_region(reply)), "\n")
    want = F.array_sort(F.transform(col(options), lambda o: F.lower(o)))

    def names(line: Column) -> Column:
        return F.array_sort(F.transform(F.split(line, r"\s*(?:>=|=>|≥|>>|>|~=|=|~)\s*"), lambda p: F.trim(F.regexp_replace(p, r"[^\w \-]", ""))))

    good = F.filter(lines, lambda x: names(x) == want)
    line = F.when(F.size(good) > 0, F.trim(F.element_at(good, -1)))
    top = F.trim(F.get(F.split(line, r"\s*(?:>=|=>|≥|>>|>)\s*"), F.lit(0)))
    label = F.when(line.isNull() | top.rlike("[=~]"), PARSE_FAILED).otherwise(F.coalesce(canonical(F.regexp_replace(top, r"[^\w \-]", ""), options), F.lit(PARSE_FAILED)))
    return F.struct(line.alias("ranking"), label.alias("label"))


def is_degenerate(reply, times: int = 6, least: int = 15) -> Column:
    """A sentence of at least ``least`` characters occurs ``times`` times or more."""
    t = F.coalesce(col(reply), F.lit(""))
    sentences = F.array_distinct(F.filter(F.transform(F.split(t, r"[.!?\n]+"), F.trim), lambda s: F.length(s) >= least))
    return F.exists(sentences, lambda s: (F.length(t) - F.length(F.replace(t, s, F.lit("")))) / F.length(s) >= times)


def score_answer(label, truth) -> Column:
    """True or false where truth and label are known, else null."""
    known = blank_to_null(truth).isNotNull() & (F.lower(F.trim(col(truth))) != "unknown") & ~col(label).isin(PARSE_FAILED, "ERROR")
    return F.when(known, F.lower(F.trim(col(label))) == F.lower(F.trim(col(truth))))


def render_messages(messages) -> Column:
    """``[role] text`` of an array of struct(role, text), joined by blanks."""
    return F.array_join(F.transform(col(messages), lambda m: F.concat(F.lit("["), m["role"], F.lit("] "), m["text"])), " ")
