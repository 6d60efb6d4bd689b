"""Benchmark decontamination over templates: numbers, names and units become typed placeholders.

Texts and benchmark items are cut into windows of template words. Windows are joined by hash; the values in their
slots are compared along an alignment of document and item: a value of the item stands for itself if it is met again, or
else for the value that it meets in most windows, and windows that hold another one don't count. So a question asked
again with other numbers or names is found, and a chance meeting of templates with contradictory slots is not. A
capitalised word that begins a sentence may be a name or not, so windows with one are joined both ways. Items that are
short or mostly slots are compared by their exact words. A document is contaminated by an item if consistent windows
cover at least ``COVERAGE`` of the item's windows. Items that differ in the values of their slots alone, alike wherever
values are equal, are one class: its smallest id stands for all, so a template of many items isn't joined many times.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import pairs as P
from ._common import MARK_BITS, need, numbered, place, small_batches, stage, type_of

#: Words in a window (a shorter item is one window, of exact words if under LEAST), share of an item to be covered.
WINDOW, LEAST, COVERAGE = 8, 5, 0.5
#: A benchmark of at most this many windows is broadcast; larger ones are joined by a shuffle.
BROADCAST_WINDOWS = 500_000
#: Documents to drop that are broadcast at most.
BROADCAST_IDS = 200_000
#: Units of measure and currency, spelled in lower case.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t oz lb lbs ml cl l gal s sec secs min mins h hr hrs hour hours day days week weeks month months year years hz khz mhz ghz w kw mw v kv a ma pa kpa bar psi j kj cal kcal c f k usd eur gbp dollars dollar euros euro pounds percent % $ € £ °".split())
_TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+|[%$€£°]|[.!?\n]+")
_NUMBER, _NAME, _UNIT = "\x01number", "\x01name", "\x01unit"
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MARK, _CAPITAL, _PLAIN, _NUM, _MEASURE = range(5)


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) >> 4


class _Words(dict):
    """Hash and class of a token in one number, kept for the tokens met lately. With ``known``, the hashes of the words that
    are looked for, all other words have one hash, that of no word, and are kept only if they aren't in lower case."""

    def __init__(self, known: dict[str, int] | None = None) -> None:
        super().__init__()
        self.known = known
        self.lower = {w: self[w] for w in {*known, *UNITS}} if known is not None else {}

    def codes(self, tokens: list[str]) -> np.ndarray:
        if self.known is None:
            return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))
        common, other = self.lower.get, _OTHER << 3 | _PLAIN
        return np.array([common(t) or (other if t.islower() else self[t]) for t in tokens], np.uint64)

    def __missing__(self, token: str) -> int:
        if len(self) > 100_000:
            self.clear()
        low, first = token.lower(), token[0]
        if low in UNITS:
            code = _MEASURE
        elif first.isalpha():
            code = _CAPITAL if low != token and first.isupper() and token[1:].islower() else _PLAIN
        else:
            code = _MARK if first in ".!?\n" else _NUM if first.isdigit() else _PLAIN
        v = self[token] = (_hash(low) if self.known is None else self.known.get(low, _OTHER)) << 3 | code
        return v


_OTHER = _hash("\x02other")
_WORDS = _Words()
_SLOTS = np.array([_hash(_NUMBER), _hash(_NAME), _hash(_UNIT)], np.uint64)


class Template:
    """A whole text's words without marks of sentences: their own hashes, and template hashes and slots of both readings.

    In the first reading a capitalised word is a name unless it begins a sentence, in the second one also there. A unit
    is a slot only next to a number.
    """

    def __init__(self, text: str | None, words: _Words = _WORDS) -> None:
        tokens = _TOKEN.findall(text or "")
        codes = words.codes(tokens)
        kind = (codes & np.uint64(7)).astype(np.int64)
        hashes = codes >> np.uint64(3)
        first = np.ones(len(tokens), bool)
        first[1:] = kind[:-1] == _MARK
        near = np.zeros(len(tokens), bool)
        near[1:] |= kind[:-1] == _NUM
        near[:-1] |= kind[1:] == _NUM
        number, capital, unit = kind == _NUM, kind == _CAPITAL, (kind == _MEASURE) & near
        keep = kind != _MARK
        self.words = tokens if keep.all() else [tokens[i] for i in np.nonzero(keep)[0].tolist()]
        self.own = hashes[keep]
        self.readings = []
        for name in (capital & ~first, capital):
            out = hashes.copy()
            for k, at in enumerate((number, name, unit)):
                out[at] = _SLOTS[k]
            self.readings.append((out[keep], (number | name | unit)[keep]))

    def values(self, reading: int, at: int, size: int) -> list[str]:
        """Values of the slots of a window."""
        slots = self.readings[reading][1]
        return [self.words[k].lower() for k in range(at, at + size) if slots[k]]

    def windows(self, size: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each reading (hashes, places, whether by the template) of its windows; of the second reading only windows
        by the template that the first one hasn't."""
        n = len(self.words) - size + 1
        if n < 1:
            return []
        (hashes, slots), (hashes2, slots2) = self.readings
        h, loose = windows(hashes, slots, self.own, size)
        out = [(h, np.arange(n), loose)]
        extra = np.concatenate([[0], np.cumsum(slots != slots2)])
        if extra[-1]:
            h, loose = windows(hashes2, slots2, self.own, size)
            at = np.nonzero(loose & (extra[size:] > extra[:-size]))[0]
            out.append((h[at], at, loose[at]))
        return out

    def alike(self) -> str:
        """Equal for texts of equal templates whose slots hold equal values at the same places."""
        hashes, slots = self.readings[0]
        _, at, place = np.unique(self.own[slots], return_index=True, return_inverse=True)
        return xxhash.xxh3_128_hexdigest(hashes.tobytes() + b"|" + at[place].astype(np.int64).tobytes())


def _rolled(hashes: np.ndarray, size: int, seed: int) -> np.ndarray:
    n = len(hashes) - size + 1
    out = np.full(n, np.uint64(seed))
    for k in range(size):
        out = (out ^ hashes[k : k + n]) * _PRIME
        out ^= out >> np.uint64(29)
    return out


def windows(hashes: np.ndarray, slots: np.ndarray, own: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hash, whether it is the template's) of each window of ``size`` words.

    Windows of under LEAST words, or of which more than half are slots, are hashed by their exact words.
    """
    n = len(hashes) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    total = np.concatenate([[0], np.cumsum(slots)])
    loose = (total[size:] - total[:-size] <= size // 2) & (size >= LEAST)
    out = _rolled(hashes, size, size) if loose.any() else np.zeros(n, np.uint64)
    if not loose.all():
        out = np.where(loose, out, _rolled(own, size, size | 1 << 32))
    return out, loose


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(h, item, size, place, windows, slots, alike): every window of every item; ``windows`` is their number in the item.

    Windows by exact words count only in items that have no others. Null ids, and texts without words, have none. Equal
    rows count once. Items of equal ``alike`` are a class.
    """
    small_batches(benchmark.sparkSession)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, text in zip(pdf["item"], pdf["text"], strict=True):
                t = Template(text)
                size = min(WINDOW, len(t.words))
                if not size:
                    continue
                found = t.windows(size)
                exact = not any(loose.any() for _, _, loose in found)
                rows = [(int(x), r, int(a)) for r, (h, at, loose) in enumerate(found) for x, a, f in zip(h.view(np.int64), at, loose, strict=True) if f or exact]
                alike = xxhash.xxh3_128_hexdigest(t.own.tobytes()) if exact else t.alike()
                n = len({a for _, _, a in rows})
                out += [(x, i, size, a, n, t.values(r, a, size), alike) for x, r, a in rows]
            yield pd.DataFrame(out, columns=["h", "item", "size", "place", "windows", "slots", "alike"])

    rows = need(benchmark, id_col, text_col).toDF("item", "text").withColumn("text", F.col("text").cast("string")).where("item is not null").distinct()
    return rows.mapInPandas(cut, f"h long, item {type_of(benchmark, id_col)}, size int, place int, windows int, slots array<string>, alike string")


def item_classes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, stands_for): the item that stands for each item's class; items without words are in no class."""
    items = benchmark_windows(benchmark, id_col, text_col).select("item", "alike").distinct()
    first = items.groupBy("alike").agg(F.min("item").alias("stands_for"))
    return items.join(first, "alike").select(F.col("item").alias(id_col), "stands_for")


def benchmark_words(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(word): every word of the items that have an id, in lower case."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"word": sorted({w.lower() for t in pdf["text"] for w in _TOKEN.findall(t or "")})}, dtype=object)

    rows = need(benchmark, id_col, text_col).toDF("item", "text").where("item is not null").select(F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(cut, "word string").distinct()


def benchmark_pairs(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(h): the hashes of all neighbours in items that have an id, by themselves and as the slots that they may be."""
    small_batches(benchmark.sparkSession)

    def symbols(token: str) -> list[int]:
        code = _WORDS[token] & 7
        return [P.NUMBER] if code == _NUM else [P.spelled(token.lower()), P.SLOT] if code in (_CAPITAL, _MEASURE) else [P.spelled(token.lower())]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = {(P.NUMBER, P.NUMBER)}
            for text in pdf["text"]:
                found.update(x for a, b in itertools.pairwise(map(symbols, Template(text).words)) for x in itertools.product(a, b))
            both = np.array(sorted(found), np.uint32)
            yield pd.DataFrame({"h": P.paired(both[:, 0], both[:, 1]).view(np.int64)})

    rows = need(benchmark, id_col, text_col).toDF("item", "text").where("item is not null").select(F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(cut, "h long")


def _bits(hashes: DataFrame) -> np.ndarray:
    """Filter of MARK_BITS bits over the column ``h``."""
    bit = F.pmod("h", F.lit(MARK_BITS)) + 1
    found = hashes.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    out = np.zeros(MARK_BITS // 8, np.uint8)
    for r in found.collect():  # MARK_BITS / 8 bytes in all
        part = np.frombuffer(bytes(r.bits), np.uint8)
        out[(r.bucket - 1) * 4096 : (r.bucket - 1) * 4096 + len(part)] = part
    return out


class Wanted:
    """The hashes that are looked for: a sorted array, or the bits of a filter of fixed size, which lets others pass too;
    the bits of a filter of the neighbours in them; and the words that they are made of, if those are given."""

    def __init__(self, items: DataFrame, exact: bool, pairs: DataFrame, words: list[str] | None = None) -> None:
        self.exact, self.words, self.pairs = exact, words, _bits(pairs)
        if exact:
            self.known = np.unique(np.array([r.h for r in items.select("h").distinct().collect()], np.int64).view(np.uint64))
        else:
            self.known = _bits(items)

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that are wanted, or may be."""
        if self.exact:
            if not len(self.known):
                return np.zeros(0, np.int64)
            return np.nonzero(self.known[np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)] == h)[0]
        at = h % np.uint64(MARK_BITS)
        return np.nonzero(self.known[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)[0]


def document_windows(docs: DataFrame, sizes: list[int], wanted: Wanted, id_col: str, text_col: str) -> DataFrame:
    """(h, id, at, found): windows of the given sizes whose hash is wanted. Texts without a run of words that are
    neighbours in items too have none, and aren't taken apart (see ``pairs``)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words(None if shared.value.words is None else {w: _hash(w) for w in shared.value.words})
        for pdf in batches:
            out = []
            pdf = pdf[P.passes(pdf["text"].tolist(), min(sizes, default=1), shared.value.pairs)]
            for i, text in zip(pdf["id"], pdf["text"], strict=True):
                t = Template(text, words)
                for size in sizes:
                    for r, (h, at, _) in enumerate(t.windows(size)):
                        hit = shared.value.hits(h)
                        out += [(x, i, a, t.values(r, a, size)) for x, a in zip(h[hit].view(np.int64).tolist(), at[hit].tolist(), strict=True)]
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=["h", "id", "at", "found"])
                    out = []
            yield pd.DataFrame(out, columns=["h", "id", "at", "found"])

    rows = need(docs, id_col, text_col).toDF("id", "text").withColumn("text", F.col("text").cast("string")).where("id is not null and text is not null")
    return rows.mapInPandas(cut, f"h long, id {type_of(docs, id_col)}, at int, found array<string>")


def consistent(places: pd.Series, slots: pd.Series, found: pd.Series) -> pd.DataFrame:
    """Places of an alignment's windows without a contradictory slot, and whether one of their slots has another value."""
    out = []
    for at, mine, theirs in zip(places, slots, found, strict=True):
        pairs = [set(zip(a, b, strict=True)) for a, b in zip(mine, theirs, strict=True)]
        best: dict[str, tuple[bool, int, str]] = {}
        for (a, b), n in Counter(x for p in pairs for x in p).items():
            best[a] = max(best.get(a, (False, 0, "")), (a == b, n, b))
        good = [k for k, p in enumerate(pairs) if all(best[a][2] == b for a, b in p)]
        out.append(([int(at[k]) for k in good], any(a != b for k in good for a, b in pairs[k])))
    return pd.DataFrame(out, columns=["places", "changed"])


def candidates(found: DataFrame, items: DataFrame, coverage: float, small: bool) -> DataFrame:
    """(id, item) of documents that hold one of an item's rarest windows.

    A document that covers the share ``coverage`` of an item's n places, m of them at least, holds one of any n - m + 1.
    Those that the fewest of the documents' windows meet are taken, so a phrase that many items and documents share joins
    nothing by itself.
    """
    met = found.groupBy("h").agg(F.count(F.lit(1)).alias("met"))
    places = items.join(met, "h", "left").groupBy("item", "place").agg(F.max("windows").alias("windows"), F.coalesce(F.sum("met"), F.lit(0)).alias("met"))
    rarest = F.row_number().over(Window.partitionBy("item").orderBy("met", "place"))  # windows of one item
    few = places.withColumn("_r", rarest).where(F.col("_r") <= F.col("windows") - F.ceil(F.col("windows") * coverage - 1e-9) + 1).where("met > 0").select("item", "place")
    keys = items.join(few, ["item", "place"]).select("h", "item").distinct()
    return found.select("id", "h").join(F.broadcast(keys) if small else keys, "h").select("id", "item").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(id, item, coverage, changed_slots): every document and class of items that contaminates it; the item is the one
    that stands for its class (see :func:`item_classes`).

    ``changed_slots`` is true if a slot's value differs from that item's: the question was asked with other values.
    Ids are of any type that has an order. Null ids and texts match nothing; rows of one id count as one document; texts
    of any length are read whole; extra columns are left behind; an empty side gives an empty result.
    """
    every = stage(benchmark_windows(benchmark, item_col, item_text_col), "items")
    first = every.groupBy("alike").agg(F.min("item").alias("item"))
    items = stage(every.join(first, ["alike", "item"], "left_semi").drop("alike"), "items")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())
    small = items.count() <= broadcast_windows
    words = [r.word for r in benchmark_words(benchmark, item_col, item_text_col).collect()] if small else None
    found = stage(document_windows(docs, sizes, Wanted(items, small, benchmark_pairs(benchmark, item_col, item_text_col), words), id_col, text_col), "found-windows")
    pairs = candidates(found, items, coverage, small)
    hits = pairs.join(F.broadcast(items) if small else items, "item").join(found, ["id", "h"]).where("size(slots) = size(found)")
    aligned = hits.groupBy("id", "item", (F.col("at") - F.col("place")).alias("shift")).agg(F.max("windows").alias("windows"), F.collect_set(F.struct("place", "slots", "found")).alias("hits"))
    judge = F.pandas_udf(consistent, "places array<int>, changed boolean")
    kept = aligned.select("id", "item", "windows", judge("hits.place", "hits.slots", "hits.found").alias("_k")).select("id", "item", "windows", "_k.places", "_k.changed")
    covered = kept.select("id", "item", "windows", "changed", F.explode("places").alias("place")).groupBy("id", "item").agg(
        (F.count_distinct("place") / F.max("windows")).alias("coverage"), F.every("changed").alias("changed_slots")
    )
    return covered.where(F.col("coverage") >= coverage).select(F.col("id").alias(id_col), F.col("item").alias(item_col), "coverage", "changed_slots")


def contaminated_documents(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, contaminated true, items, coverage, changed_slots) of every contaminated document."""
    pairs = contaminated(docs, benchmark, coverage, id_col, text_col)
    return pairs.groupBy(id_col).agg(F.lit(True).alias("contaminated"), F.sort_array(F.collect_set("item_id")).alias("items"), F.max("coverage").alias("coverage"), F.every("changed_slots").alias("changed_slots"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """``docs`` without the contaminated documents; rows with a null id stay. Columns keep their names, whatever they are."""
    drop = stage(contaminated(docs, benchmark, coverage, id_col, text_col).select(F.col(id_col).alias("leak")).distinct(), "leaks")
    side = F.broadcast(drop) if drop.count() <= broadcast_ids else drop.hint("shuffle_hash")
    plain = numbered(docs)
    return plain.join(side, plain[f"_{place(docs, id_col)}"] == side["leak"], "left_anti").toDF(*docs.columns)
