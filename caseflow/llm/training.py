"""Bounded training rows for the classifiers, and the hold-out rule that they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import need

#: Labelled documents that a classifier is fitted on, at most; chosen by a hash of the id.
TRAIN_ROWS = 8_000
_BUCKETS = 1 << 31


def held_out(id_col: Column) -> Column:
    """True where crc32 of the id's text leaves 1 on division by 3; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> DataFrame:
    """(id, text, label 0/1) of at most ``rows`` labelled documents outside the hold-out; ``id`` is the id's text.

    Ids are of any type; those of both tables meet by their text, by which the hold-out is told too. Repeated labels of
    one id are averaged (a tie counts as 1); null labels are ignored. An id that several rows have is learned from one of
    them, the first by a hash of its text, so repeats don't pass the bound. The label rows kept are bounded by ``rows``,
    so they are broadcast; only chosen texts are shuffled.
    """
    given = need(labels, id_col, label_col).select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{label_col}`").cast("double").alias("y"))
    given = given.where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id")))
    given = given.groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("label"))
    n = given.count()
    if n > rows:
        cut = int(_BUCKETS * 1.1 * rows / n)
        given = given.where(F.pmod(F.xxhash64("id", F.lit("train")), F.lit(_BUCKETS)) < cut)
    given = given.orderBy(F.xxhash64("id", F.lit("train"))).limit(rows)
    texts = need(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("string").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    one = texts.join(F.broadcast(given), "id").groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("at"), "text", "label")).alias("v"))
    return one.select("id", "v.text", "v.label")
