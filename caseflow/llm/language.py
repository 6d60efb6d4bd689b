"""Language ID by rank-order profiles: out-of-place distance between a text's most frequent n-grams and each language's."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import need, numbered, place, small_batches
from .training import held_out

#: n-grams in a language's profile, n-grams of a document that are compared, and the tag of a text without letters.
PROFILE, DOCUMENT, UNDETERMINED = 400, 300, "und"
#: Documents of each language, at most, that its profile is learned from; chosen by a hash of the id.
LANGUAGE_ROWS = 2_000
_EDGE = sys.maxunicode + 1
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTER[0]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of a text's 1- to 3-grams within words, word edges included; codes ascending.

    A code holds up to three code points of 21 bits; the edge of a word has a code point of its own.
    """
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.concatenate([[_EDGE], np.where(letter, points, _EDGE), [_EDGE]]).astype(np.int64)
    keep = c != _EDGE
    keep[1:] |= c[:-1] != _EDGE
    keep[0] = True
    c = c[keep]
    two = (c[:-1] << 42) | (c[1:] << 21)
    two = two[(c[:-1] != _EDGE) | (c[1:] != _EDGE)]
    three = ((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[c[1:-1] != _EDGE]
    return np.unique(np.concatenate([c[c != _EDGE] << 42, two, three]), return_counts=True)


def ranked(text: str | None, most: int = DOCUMENT) -> np.ndarray:
    """Codes of the ``most`` most frequent n-grams, most frequent first, ties to the smaller code."""
    codes, counts = grams(text)
    return codes[np.argsort(-counts, kind="stable")[:most]]


def learn_profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = LANGUAGE_ROWS, size: int = PROFILE) -> dict[str, list[int]]:
    """Each language's ``size`` most frequent n-grams, from at most ``rows`` of its documents outside the hold-out.

    A language's share of the table doesn't matter: rare ones are learned from all that they have. The ids chosen are
    at most ``rows`` a language, so they are broadcast and no text is shuffled."""
    small_batches(docs.sparkSession)
    known = need(docs, id_col, text_col, lang_col).toDF("id", "text", "lang").withColumns({"text": F.col("text").cast("string"), "lang": F.col("lang").cast("string")})
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    draw = Window.partitionBy("lang").orderBy(F.xxhash64("id", F.lit("train")), "id")  # the limit is applied before the shuffle
    chosen = known.select("lang", "id").withColumn("at", F.row_number().over(draw)).where(F.col("at") <= rows).select("lang", "id").distinct()
    known = known.join(F.broadcast(chosen), ["lang", "id"], "left_semi")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                codes, counts = (np.concatenate(x) for x in zip(*map(grams, texts), strict=True))
                codes, at = np.unique(codes, return_inverse=True)
                yield pd.DataFrame({"lang": lang, "gram": codes, "n": np.bincount(at, counts, len(codes)).astype(np.int64)})

    totals = known.select("lang", "text").mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    profiles: dict[str, list[int]] = {}
    for r in sorted(top.collect(), key=lambda r: (r.lang, r.rank)):
        profiles.setdefault(r.lang, []).append(r.gram)
    return profiles


class Matcher:
    """Out-of-place distances to a set of profiles."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE) -> None:
        self.langs, self.size = sorted(profiles), size
        self.codes = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, np.array(profiles[lang], np.int64)), k] = np.arange(len(profiles[lang]))

    def best(self, text: str | None) -> tuple[str, float]:
        """Nearest language and 1 - distance / largest possible distance; ties to the first in name order."""
        own = ranked(text)
        if not len(own) or not self.langs:
            return UNDETERMINED, 0.0
        at = np.searchsorted(self.codes, own)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != own)] = len(self.codes)
        ranks = self.ranks[at]
        out = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))[:, None])).sum(0)
        k = int(np.argmin(out))
        return self.langs[k], max(0.0, 1.0 - float(out[k]) / (self.size * len(own)))


def language_of(spark: SparkSession, profiles: dict[str, list[int]]):
    """Function of a whole text's column: struct(lang_pred, score)."""
    small_batches(spark)
    matcher = spark.sparkContext.broadcast(Matcher(profiles))

    @F.pandas_udf("lang_pred string, score double")
    def identify(texts: pd.Series) -> pd.DataFrame:
        best = matcher.value.best
        return pd.DataFrame([best(t) for t in texts], columns=["lang_pred", "score"])

    return identify


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = LANGUAGE_ROWS) -> DataFrame:
    """(id, held_out, lang_pred, score) for every row; ``und`` and 0 for a null text, one without letters, or where
    no language could be learned. A text of any length is read whole, ties go to the first language in name order,
    repeated rows stay repeated, extra columns are left behind, an empty table gives an empty result."""
    identify = language_of(docs.sparkSession, learn_profiles(docs, id_col, text_col, lang_col, rows))
    found = need(docs, id_col, text_col).toDF("id", "text")
    found = found.select("id", held_out(F.col("id")).alias("held_out"), identify(F.col("text").cast("string")).alias("found"))
    return found.select(F.col("id").alias(id_col), "held_out", "found.lang_pred", "found.score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = LANGUAGE_ROWS) -> DataFrame:
    """``docs`` without the rows whose language can't be told (no letters, or no text); all columns stay, whatever
    their names."""
    identify = language_of(docs.sparkSession, learn_profiles(docs, id_col, text_col, lang_col, rows))
    text, plain = F.col(f"_{place(docs, text_col)}").cast("string"), numbered(docs)
    return plain.withColumn("found", identify(text)).where(F.col("found.lang_pred") != UNDETERMINED).drop("found").toDF(*docs.columns)
