"""Phrase collocations by top-order marginalisation: only the longest windows are counted, ROLLUP sums their prefixes.

Every word begins one window of ORDER words, padded where its piece ends. Counts of all shorter phrases are sums over
windows with that prefix, so Spark's ROLLUP over the window's columns gives the count of each phrase of 1 to ORDER
words, and at the level of the language alone the number of words; no n-gram is exploded by itself.

All parts of a phrase that occurs ``least`` times do so too. Counts of hashed keys come first, of words, of pairs of the
words left, and of triples of the pairs left, and a window is padded from the word on that makes it rarer. This cuts
only prefixes that are no candidates. The keys pass as bit filters whose size follows their number, up to MOST_BITS;
false hits leave windows longer than needed and change no result. What a task has counted travels in blocks, one for
each part of the keys, and is summed part by part.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import need, stage, unstage

ORDER = 5
#: Bytes of text that are counted together in a task.
CHUNK_BYTES = 4 << 20
#: Keys, and windows, that a task sums up before it passes them on.
HELD_KEYS, HELD_WINDOWS = 1 << 20, 1 << 19
#: Phrases up to this many words are counted by keys first.
FILTERED = 3
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 30
UNKNOWN = "und"

#: A-Z become a-z, marks that end a piece become line feeds, tabs become spaces. All are single bytes in UTF-8.
_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """Words of a run of pieces: distinct words, the number of each word, and whether the next one continues its piece."""

    def __init__(self, raw: bytes, lang: str) -> None:
        chars = np.frombuffer(raw, np.uint8)
        inside = np.zeros(len(chars) + 2, np.int8)
        inside[1:-1] = (chars != 32) & (chars != 10)
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        offsets = np.zeros(len(start) + 1, np.int64)
        np.cumsum(end - start, out=offsets[1:])
        data = chars[inside[1:-1].view(bool)].tobytes()
        words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        self.ids = words.indices.to_numpy()
        self.words = words.dictionary.cast(pa.large_string())
        pieces = np.searchsorted(np.flatnonzero(chars == 10), start)
        self.joined = pieces[1:] == pieces[:-1]
        seed = xxhash.xxh32_intdigest(lang)
        self.keys = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words.dictionary.to_pylist()), np.uint64, len(self.words))

    def gram_keys(self, k: int, places: np.ndarray) -> np.ndarray:
        """Key of the ``k`` words at each place."""
        key = self.keys[self.ids[places]]
        for step in range(1, k):
            key = key * _MIX
            key = (key ^ (key >> np.uint64(29))) + self.keys[self.ids[places + step]]
        return key

    def places(self, filters: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """For k = 1, 2, ... whether the k words at each place pass the k-th filter, as do all shorter phrases in them;
        and the places where the next longer phrase may pass too."""
        passed, at = [], np.arange(len(self.ids))
        for k, bits in enumerate(filters, 1):
            good = np.zeros(len(self.ids), bool)
            good[at[member(self.gram_keys(k, at), bits)] if k > 1 else member(self.keys, bits)[self.ids]] = True
            passed.append(good)
            at = np.flatnonzero(good[:-1] & good[1:] & self.joined)
        return passed, at


def member(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    place = keys & np.uint64(len(bits) * 8 - 1)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(language, text) of about CHUNK_BYTES at most, in which pieces are whole; longer texts are cut between pieces."""
    held, size = defaultdict(list), 0

    def flush() -> Iterator[tuple[str, bytes]]:
        for lang, texts in held.items():
            raw, at = b"\n".join(texts).translate(_BYTES), 0
            while at < len(raw):
                end = len(raw) if len(raw) - at <= CHUNK_BYTES else raw.rfind(b"\n", at, at + CHUNK_BYTES)
                if end <= at:  # a piece that is longer
                    end = raw.find(b"\n", at + CHUNK_BYTES)
                    end = len(raw) if end < 0 else end
                yield lang, raw[at:end]
                at = end + 1

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
            held[lang].append(text)
            size += len(text)
            if size >= CHUNK_BYTES:
                yield from flush()
                held, size = defaultdict(list), 0
    yield from flush()


def in_blocks(table: pa.Table, part: np.ndarray) -> pa.RecordBatch:
    """Rows of a table as a block for each part: lists of what the columns hold."""
    order = np.argsort(part, kind="stable")
    parts, first = np.unique(part[order], return_index=True)
    ends, table = pa.array(np.append(first, len(order)), pa.int32()), table.take(pa.array(order))
    lists = [pa.ListArray.from_arrays(ends, c.combine_chunks()) for c in table.columns]
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *lists], ["part", *table.column_names])


def sum_blocks(blocks: DataFrame, kinds: dict[str, str], least: int) -> DataFrame:
    """Rows of all blocks with the sum of ``n`` of equal ones, of those where it is ``least`` or more. Blocks of a part
    meet in one task; parts are even, as a task adds a row once, whatever its count."""

    def add(blocks: pa.Table) -> pa.Table:
        flat = pa.table({c: pa.compute.list_flatten(blocks.column(c)) for c in [*kinds, "n"]})
        total = flat.group_by([*kinds]).aggregate([("n", "sum")]).rename_columns([*kinds, "n"])
        return total.filter(pa.compute.field("n") >= least)

    return blocks.groupBy("part").applyInArrow(add, "".join(f"{c} {kind}, " for c, kind in kinds.items()) + "n long")


def frequent_keys(docs: DataFrame, least: int, shorter: list) -> np.ndarray:
    """Filter of the keys of phrases, one word longer than the last of the filters ``shorter``, that occur ``least``
    times or more and whose parts pass those filters."""
    parts = parts_for(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            n = np.bincount(where, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)
            return in_blocks(pa.table({"key": keys.view(np.int64), "n": n}), (keys >> np.uint64(32)) % np.uint64(parts))

        for lang, raw in chunks(batches):
            found = Words(raw, lang)
            at = found.places([f.value for f in shorter])[1]
            held.append(np.unique(found.gram_keys(len(shorter) + 1, at), return_counts=True) if shorter else (found.keys, np.bincount(found.ids, minlength=len(found.keys))))
            size += len(held[-1][0])
            if size > HELD_KEYS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    blocks = docs.mapInArrow(count, "part int, key array<long>, n array<long>")
    keys = stage(sum_blocks(blocks, {"key": "long"}, least).select("key"), "collocation-keys")
    size = min(max(1 << (16 * keys.count()).bit_length(), LEAST_BITS), MOST_BITS)
    place = F.col("key").bitwiseAND(F.lit(size - 1)) + 1
    marks = keys.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    bits = np.zeros(size // 8, np.uint8)
    for row in marks.collect():  # of MOST_BITS / 8 bytes at most in all
        part = np.frombuffer(row.bits, np.uint8)
        bits[(row.bucket - 1) * len(part) :][: len(part)] = part
    unstage(keys)
    return bits


def parts_for(docs: DataFrame) -> int:
    return 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def count_windows(docs: DataFrame, filters: list) -> DataFrame:
    """(lang, w1 ... w5, n): windows by their words, '' beyond the last; ``filters`` are for phrases of 1, 2, ... words."""
    names, parts = [f"w{k}" for k in range(1, ORDER + 1)], parts_for(docs)

    def summed(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by(["part", "lang", *names]).aggregate([("n", "sum")]).rename_columns(["part", "lang", *names, "n"])

    def block(tables: list[pa.Table]) -> pa.RecordBatch:
        table = summed(tables)
        return in_blocks(table.drop_columns("part"), table.column("part").to_numpy())

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for lang, raw in chunks(batches):
            found = Words(raw, lang)
            passed, _ = found.places([f.value for f in filters])
            size = len(found.ids)
            ids, joined = np.append(found.ids + 1, np.zeros(ORDER, np.int32)), np.append(found.joined, np.zeros(ORDER + 1, bool))
            open_, columns = np.ones(size, bool), []
            for k in range(1, ORDER + 1):  # the window holds its k-th word if its first k words may be frequent
                own = passed[min(k, len(passed)) - 1]
                open_ = open_ & np.append(own, np.zeros(ORDER, bool))[max(0, k - len(passed)) :][:size]
                if k > 1:
                    open_ = open_ & joined[k - 2 :][:size]
                columns.append(np.where(open_, ids[k - 1 :][:size], 0).astype(np.int32))
            equal = pa.table(columns, names=names).group_by(names).aggregate([([], "count_all")])
            words = pa.concat_arrays([pa.array([""], pa.large_string()), found.words])
            keys, mixed = np.append(found.keys, np.uint64(0)), np.zeros(len(equal), np.uint64)
            for c in names:
                mixed = (mixed ^ (mixed >> np.uint64(31))) * _MIX + keys[equal.column(c).to_numpy() - 1]
            part = pa.array(((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int32))
            text = {c: words.take(equal.column(c).combine_chunks()).cast(pa.string()) for c in names}
            held.append(pa.table({"part": part, "lang": pa.array([lang] * len(equal), pa.string()), **text, "n": equal.column("count_all")}))
            if len(held) > 1 and sum(map(len, held)) > HELD_WINDOWS:
                held = [summed(held)]
                if len(held[0]) > HELD_WINDOWS / 2:
                    yield block(held)
                    held = []
        if held:
            yield block(held)

    blocks = docs.mapInArrow(windows, "part int, " + "".join(f"{c} array<string>, " for c in ["lang", *names]) + "n array<long>")
    return sum_blocks(blocks, dict.fromkeys(["lang", *names], "string"), 1)


def phrase_counts(docs: DataFrame, least: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, size, phrase, n) of every phrase of 1 to ORDER words that occurs ``least`` times or more in a language, its
    words joined by spaces; size 0 has the number of all words. Null languages are ``und``, null texts empty."""
    given = need(docs, lang_col, text_col)
    given = given.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    context = docs.sparkSession.sparkContext
    filters: list = []
    for _ in range(FILTERED):
        filters.append(context.broadcast(frequent_keys(given, least, filters)))
    names = [f"w{k}" for k in range(1, ORDER + 1)]
    summed = count_windows(given, filters).rollup("lang", *names).agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))
    # the level's bits are set for the columns that are summed over: no bit for whole windows, ORDER for a language
    size = F.lit(ORDER) - F.bit_count("level")
    last = F.get(F.array(F.lit("_"), *names), size.cast("int"))
    summed = summed.where((size >= 0) & (last != "") & ((F.col("n") >= least) | (size == 0)))
    return summed.select("lang", size.cast("int").alias("size"), F.concat_ws(" ", *names).alias("phrase"), "n")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language by score.

    A phrase of 2 to ORDER words with ``a`` >= ``least`` occurrences is scored floor(1000 * a * n / (l * r)) at its worst
    cut (ties: the first), where l and r count its parts and n all words. A phrase that occurs only within one longer
    candidate is dropped. Order: score and a descending, phrase ascending. Rows without words count nothing; repeated
    rows count each; an empty table gives an empty result; extra columns are left behind.
    """
    counts = stage(phrase_counts(docs, least, text_col, lang_col), "collocation-counts")
    totals = counts.where("size = 0").select("lang", F.col("n").alias("total"))
    phrases = counts.where("size > 0").select("lang", "size", "phrase", "n")
    # within a longer phrase of equal count: every phrase between them has that count too, so the next longer ones tell
    words = F.split("phrase", " ", -1)
    longer = phrases.where("size > 2").select("lang", "n", words.alias("w"), F.col("size").alias("k"))
    longer = longer.select("lang", "n", F.explode(F.array(F.slice("w", F.lit(1), F.col("k") - 1), F.slice("w", F.lit(2), F.col("k") - 1))).alias("w"))
    covered = longer.select("lang", F.concat_ws(" ", "w").alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("within"))
    candidates = phrases.where("size > 1").join(covered, ["lang", "phrase"], "left").where(F.col("within").isNull() | (F.col("within") < F.col("n")))
    candidates = candidates.select("lang", "phrase", F.col("n").alias("a"), "size", words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    candidates = candidates.select("lang", "phrase", "a", "cut", F.concat_ws(" ", F.slice("w", F.lit(1), F.col("cut"))).alias("left"), F.concat_ws(" ", F.slice("w", F.col("cut") + 1, F.col("size"))).alias("right"))
    part = lambda side, name: phrases.select("lang", F.col("phrase").alias(side), F.col("n").alias(name))
    cut = candidates.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals, "lang")
    # products may pass 64 bits: decimals of 38 digits are exact here, and so is their integral division
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(19,0)) * cast(total as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    worst = cut.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r", "a", "total")).alias("s"))
    order = Window.partitionBy("lang").orderBy(F.desc("s.score"), F.desc("s.a"), "phrase")
    ranked = worst.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "s.a", "s.l", "s.r", F.col("s.total").alias("n"), "s.score")
