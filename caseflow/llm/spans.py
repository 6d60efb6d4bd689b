"""Substring dedup by sliding spans of sentences and their parts.

A text is cut after the ends of its sentences and lines, and after the word whose hash is the least of any STEP words
in a row (ends of sentences come before other words). These cuts depend on the words alone, so a passage is cut alike
wherever it stands, from its STEP-th word to its STEP-th last at least. From every cut the shortest run that holds
``SENTENCES`` sentences and ``WORDS`` words, or ``LONG`` words, is hashed: any passage of LONG + 3 * STEP words holds
one. Hashes are joined over all documents, and pieces that lie in a repeated run which isn't the run's first
occurrence (smallest id, then earliest place) are removed. Every row is a document of its own: rows that share an id are
told apart by their texts, and of equal rows the first one is their only first occurrence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import join_counted, marks, need, small_batches, split_by_marks, stage, type_of

SENTENCES, WORDS, LONG, STEP = 3, 12, 20, 10
#: Characters of scripts without spaces: each is a word.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\ua4cf\uf900-\ufaff\uff01-\uff9f\U00020000-\U0003ffff"
_ANY_UNSPACED = re.compile(f"[{_UNSPACED}]")
_WORD = re.compile(rf"[{_UNSPACED}]|[^\s{_UNSPACED}]+")
_SENTENCE_END = re.compile(r"[.!?\u2026\u203c-\u2049\u06d4\u061f\u0964\u0965\u3002\uff01\uff0e\uff1f\uff61][\"'\u2019\u201d\u00bb)\]\u300d\u300f]*$")
_HIGH = np.uint64(1 << 63)


class _Words(dict):
    """Hash of a word without case; the top bit is unset if the word ends a sentence. Kept for the words met lately."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        v = xxhash.xxh3_64_intdigest(word.lower().encode("utf-8", "surrogatepass")) | 1 << 63
        if _SENTENCE_END.search(word):
            v ^= 1 << 63
        self[word] = v
        return v


_HASHES = _Words()


def _words(text: str) -> list[str]:
    return text.split() if text.isascii() or not _ANY_UNSPACED.search(text) else _WORD.findall(text)


def _cuts(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, ends of the cuts by words alone, ends of sentences, ends of sentences and lines).

    An end is the number of words before it; the text's end is in each of the three.
    """
    words = _words(text)
    n = len(words)
    hashes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)
    sentence = np.append(np.nonzero(hashes[:-1] < _HIGH)[0] + 1, n)
    local = sentence
    if n > STEP:
        rows = np.lib.stride_tricks.as_strided(hashes[STEP - 1 :], (n - STEP + 1, STEP), (8, -8))  # the last of equal words
        cut = np.zeros(n + 1, bool)
        cut[sentence] = True
        cut[np.arange(STEP, n + 1) - rows.argmin(1)] = True
        local = np.nonzero(cut)[0]
    line = sentence
    if "\n" in text:
        line = np.union1d(sentence, np.cumsum([len(_words(x)) for x in text.split("\n")]))
        line = line[line > 0]
    return hashes, local, sentence, line


def sentences(text: str) -> list[tuple[str, int]]:
    """(piece, number of words) in order; the pieces joined are the text."""
    starts = [m.start() for m in _WORD.finditer(text)]
    if not starts:
        return [(text, 0)] if text else []
    _, local, _, line = _cuts(text)
    ends = np.union1d(local, line)
    places = [0, *(starts[e] for e in ends[:-1]), len(text)]
    return [(text[a:b], int(n)) for a, b, n in zip(places, places[1:], np.diff(ends, prepend=0), strict=False)]


def _runs(begins: np.ndarray, ends: np.ndarray, count: int, words: int) -> np.ndarray:
    """The first of ``ends`` with ``count`` ends and ``words`` words since each begin; a large number if there is none."""
    at = np.maximum(np.searchsorted(ends, begins, "right") + count - 1, np.searchsorted(ends, begins + words))
    return np.append(ends, 1 << 40)[np.minimum(at, len(ends))]


def spans(text: str | None) -> Iterator[tuple[int, int, bytes]]:
    """(first piece, pieces, 128-bit hash) of each start; case and white space don't matter.

    A start has a span by words alone, and a second one if counting lines as sentences makes it shorter.
    """
    hashes, local, sentence, line = _cuts(text or "")
    if not len(hashes):
        return
    ends = local if line is sentence else np.union1d(local, line)
    begins = np.concatenate([[0], ends[:-1]])
    long = np.minimum(_runs(begins, local, 1, LONG), _runs(begins, sentence, SENTENCES, WORDS))
    short = long if line is sentence else _runs(begins, line, SENTENCES, WORDS)
    raw = memoryview(hashes).cast("B")
    places = zip(begins.tolist(), long.tolist(), np.searchsorted(ends, long).tolist(), short.tolist(), np.searchsorted(ends, short).tolist(), strict=True)
    for k, (begin, end, last, end2, last2) in enumerate(places):
        if end2 < end:
            yield k, last2 + 1 - k, xxhash.xxh3_128_digest(raw[8 * begin : 8 * end2])
        if end <= len(hashes):
            yield k, last + 1 - k, xxhash.xxh3_128_digest(raw[8 * begin : 8 * end])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return need(docs, id_col, text_col).toDF("id", "text").withColumn("text", F.col("text").cast("string"))


def keyed(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(``rows(id, text)`` without null ids, each with its ``key``; keys that several equal rows have, with their number).

    The key is the id if no id is repeated, or else the id and a hash of the text. Without repeats there is no second frame.
    """
    rows = rows.where("id is not null")
    if rows.groupBy("id").count().where("count > 1").isEmpty():
        return rows.withColumn("key", F.col("id")), None
    rows = rows.withColumn("key", F.struct("id", F.xxhash64("text").alias("t")))
    return rows, stage(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "equal")


def span_table(rows: DataFrame) -> DataFrame:
    """(key, first, size, h, l, again) of every span of ``rows(key, text)``; ``again`` if the same row holds it before.

    Of a hash 96 bits are kept, which is enough for 10^12 spans. Rows that are ``again`` and overlap are one row.
    """
    small_batches(rows.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, first, size, hashes, again = [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                seen = set()
                for at, n, mark in spans(t):
                    repeat = mark in seen
                    if repeat and again and again[-1] and own[-1] == i and first[-1] <= at <= first[-1] + size[-1]:
                        size[-1] = max(size[-1], at + n - first[-1])
                        continue
                    own.append(i)
                    first.append(at)
                    size.append(n)
                    hashes.append(mark)
                    again.append(repeat)
                    seen.add(mark)
            halves = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own, pa.int64())), pa.array(first, pa.int32()), pa.array(size, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1].astype(np.int32)), pa.array(again, pa.bool_())], names=["key", "first", "size", "h", "l", "again"])

    return rows.select("key", "text").mapInArrow(cut, f"key {type_of(rows, 'key')}, first int, size int, h long, l int, again boolean")


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(key, first, size) of every span of ``rows(key, text)`` that isn't its content's first occurrence."""
    table = stage(span_table(rows), "spans")
    once = table.where("not again").select("key", "first", "size", "h", "l")
    groups = once.groupBy("h", "l").agg(F.min("key").alias("owner"), F.max("key").alias("last"), F.count("*").alias("n"))
    groups = stage(groups.where("owner < last").select("h", "l", "owner", "n"), "repeats")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    copies = join_counted(once, groups, ["h", "l"], "n", total).where("key <> owner").select("key", "first", "size")
    return copies.unionByName(table.where("again").select("key", "first", "size"))


def without(text: str, cuts: Iterator[tuple[int, int]]) -> tuple[str, int, int]:
    """(text without the pieces of ``cuts``, number of these pieces, of characters)."""
    pieces = sentences(text)
    gone = np.zeros(len(pieces) + 1, np.int64)
    for first, size in cuts:
        if first < len(pieces):
            gone[first] += 1
            gone[min(len(pieces), first + size)] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    kept = "".join(p for (p, _), g in zip(pieces, gone, strict=True) if not g)
    return kept, int(gone.sum()), len(text) - len(kept)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_removed, chars_removed): texts without the pieces that a non-first repeated span covers.

    Rows of one id with different texts are documents of their own, in the order of a hash of their texts; of equal rows
    all but one lose every span. Rows with a null id or text stay as they are. A text of any length is read whole. Extra
    columns are left behind. An empty table gives an empty result. Only texts that may lose something are shuffled.
    """
    given = _rows(docs, id_col, text_col)
    rows, equal = keyed(given)
    ranges = stage(repeated_spans(rows).groupBy("key").agg(F.collect_set(F.struct("first", "size")).alias("cut")), "cuts")

    @F.pandas_udf("text string, n_removed int, chars_removed long")
    def clean(texts: pd.Series, cuts: pd.Series) -> pd.DataFrame:
        found = [(t, 0, 0) if c is None or t is None or not len(c) else without(t, ((x["first"], x["size"]) for x in c)) for t, c in zip(texts, cuts, strict=True)]
        return pd.DataFrame(found, columns=["text", "n_removed", "chars_removed"])

    @F.pandas_udf("text string, n_removed int, chars_removed long")
    def clean_copy(texts: pd.Series) -> pd.DataFrame:
        found = [(None, 0, 0) if t is None else without(t, ((first, size) for first, size, _ in spans(t))) for t in texts]
        return pd.DataFrame(found, columns=["text", "n_removed", "chars_removed"])

    if equal is not None:
        some, rest = split_by_marks(rows, "key", marks(equal, "key"))
        counted = some.groupBy("key").agg(F.any_value("id").alias("id"), F.any_value("text").alias("text"), F.count("*").alias("n"))
        counted = stage(counted, "equal")  # equal rows are combined before the shuffle
        rows = rest.unionByName(counted.drop("n"))
        copies = counted.where("n > 1").select("id", clean_copy("text").alias("c"), F.explode(F.sequence(F.lit(2), F.col("n")))).select("id", "c")
    hit, rest = split_by_marks(rows, "key", marks(ranges, "key"))
    plain = rest.select("id", "text").unionByName(given.where("id is null")).select("id", F.struct("text", F.lit(0).alias("n_removed"), F.lit(0).cast("long").alias("chars_removed")).alias("c"))
    out = hit.join(ranges.hint("shuffle_hash"), "key", "left").select("id", clean("text", "cut").alias("c")).unionByName(plain)
    if equal is not None:
        out = out.unionByName(copies)
    return out.select(F.col("id").alias(id_col), F.col("c.text").alias(text_col), "c.n_removed", "c.chars_removed")
