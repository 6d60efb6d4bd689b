"""Cross-tokenizer alignment: groups of two tokenizers' tokens that cover the same bytes, and corpus-wide pair counts.

Both tokenizers cut the same bytes. The cumulative byte ends of either's tokens are a dictionary end -> index; the ends
that both have, sorted, slice the two id lists into groups, and a slice's links are the token pairs whose byte ranges
overlap. Where neither tokenizer has a token across a space that follows a visible character, or from a letter or digit to a mark
that ends a word (``cuts_hold`` tells from the files), texts are cut there: every cut is a common end, so groups and links of the parts are those of the text, and
each distinct part is tokenized and sliced about once in a task. Else a text is one part.

How many documents hold an id pair is counted over the corpus from the distinct pairs of each document. Pairs that hold
more than 1/HOT_PAIRS of all rows, of which there are HOT_PAIRS at most, are broadcast; others meet their counts by a shuffle.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import join_counted, need, small_batches, stage, type_of

HOT_PAIRS = 200_000
#: Distinct parts, and bytes of them, that a task keeps with their alignments.
PARTS_KEPT, BYTES_KEPT = 200_000, 16 << 20

#: Words that are tokenized together.
RUN = 256

#: What either tokenizer might take for white space or drop; a cut never follows these.
_UNSURE = r"\s\x00-\x1f\x7f-\xa0\xad\u180e\u200b-\u200f\u2028-\u202f\u205f-\u206f\u2581\ufeff"
_FOLLOWED = re.compile(f"[{_UNSURE}] |  ").search
_CUT = re.compile(f"(?<=[^{_UNSURE}])(?= +[^ ])").split

#: Marks that parts are cut before where they end a word.
MARKS = ".,;:!?"
#: A piece that would reach across a cut.
_ACROSS = re.compile(f"[^▁]▁|[0-9][{MARKS}]").search


def parts_of(text: str) -> list[str | bytes]:
    """Parts of space + text: cut before spaces that follow a visible character, and before the marks that end a word.

    Words are without their first space; marks are bytes, so that they aren't taken for a word."""
    plain = text[:1] != " " and text[-1:] != " " and not _FOLLOWED(text)
    out: list[str | bytes] = []
    for part in text.split(" ") if plain else [p[1:] for p in _CUT(" " + text)]:
        if part and part[-1] in MARKS:
            word = part.rstrip(MARKS)
            if word and (word[-1].isalpha() or word[-1] in "0123456789"):
                out.append(word)
                part = part[len(word) :].encode()
        out.append(part)
    return out


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> list[tuple[int, int, int]]:
    """(end, tokens of a up to it, tokens of b up to it) of each byte end that tokens of both have, in their order."""
    upto_a = dict(zip(ends_a.tolist(), range(1, len(ends_a) + 1), strict=True))
    upto_b = dict(zip(ends_b.tolist(), range(1, len(ends_b) + 1), strict=True))
    return [(end, upto_a[end], upto_b[end]) for end in sorted(upto_a.keys() & upto_b.keys())]


def links_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end, place in a, place in b) of every two tokens whose bytes overlap: two ranges share one stretch between
    neighbouring ends of either, if any, and each such stretch is in one token of a and one of b."""
    ends = np.union1d(ends_a, ends_b)
    return ends, np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


def byte_letters() -> dict[str, int]:
    """Letter of a byte-level vocabulary -> byte: visible Latin-1 stands for itself, the rest follows from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """A byte-level BPE (JSON file) and a sentence-piece model; lives in the task that made it."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are then ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters, vocabulary = byte_letters(), self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.bytes_a[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.size_a, self.size_b = np.array(list(map(len, self.bytes_a))), np.array(list(map(len, self.bytes_b)))
        self.names_a, self.names_b = [f"{k}|" for k in range(len(self.bytes_a))], [str(k) for k in range(len(self.bytes_b))]
        self.whole = not cuts_hold(path_a, path_b)

    def encode(self, parts: list[str | bytes]) -> Iterator[tuple[list[str | bytes], bytes, list[int], list[int]]]:
        """(parts, their bytes, ids of either tokenizer) of runs of parts, all parts in their order. Words that end
        visibly are joined to runs, in which the cuts hold as in a text; other parts are alone. A part that either
        tokenizer doesn't give back is alone and has no ids."""
        runs: list[list[str | bytes]] = [[]]
        for p in parts:
            if not (isinstance(p, str) and p and p[0] != " " and (p[-1].isalnum() or "!" <= p[-1] <= "~")):
                runs += [[p], []]
                continue
            runs[-1].append(p)
            if len(runs[-1]) == RUN:
                runs.append([])
        yield from self._encode([r for r in runs if r])

    def _encode(self, runs: list[list[str | bytes]]) -> Iterator[tuple[list[str | bytes], bytes, list[int], list[int]]]:
        marks = [isinstance(r[0], bytes) for r in runs]
        words = ["a" + r[0].decode() if m else " ".join(r) for r, m in zip(runs, marks, strict=True)]
        coded = zip(runs, marks, words, self.a.encode_batch_fast([" " + w for w in words], add_special_tokens=False), self.b.encode(words, num_threads=1), strict=True)
        for run, mark, text, a, b in coded:
            raw, ids = (run[0], (a.ids[1:], b[1:])) if mark else ((" " + text).encode(), (a.ids, b))  # marks follow a letter, which is one token
            if all(b"".join([own[x] for x in y]) == raw for own, y in zip((self.bytes_a, self.bytes_b), ids, strict=True)):
                yield run, raw, *ids
            elif len(run) > 1:
                yield from self._encode([[p] for p in run])
            else:
                yield run, b"", [], []


def cuts_hold(path_a: str, path_b: str) -> bool:
    """Whether no token of either file can reach across the cuts of ``parts_of``."""
    from sentencepiece import sentencepiece_model_pb2

    with open(path_a, encoding="utf-8") as f:
        a = json.load(f)
    before = a["pre_tokenizer"] or {}
    first = a["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"]
    model = sentencepiece_model_pb2.ModelProto()
    with open(path_b, "rb") as f:
        model.ParseFromString(f.read())
    spec, trained = model.normalizer_spec, model.trainer_spec
    plain = not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and spec.escape_whitespaces and not trained.treat_whitespace_as_suffix
    return bool(first and plain and trained.model_type == trained.BPE and not any(p.type == p.USER_DEFINED or _ACROSS(p.piece) or any(x.isalpha() and y in MARKS for x, y in pairwise(p.piece)) for p in model.pieces))


class Parts:
    """Alignments of the parts met lately, by number."""

    def __init__(self, tokenizers: Tokenizers) -> None:
        self.of = tokenizers
        self.clear()

    def clear(self) -> None:
        self.number: dict[str | bytes, int] = {}
        self.pair_number: dict[int, int] = {}
        self.groups: list[str] = []
        #: tokens of a, of b, groups, links of each part; -1 where the tokens' bytes aren't the part's
        self.sizes = np.zeros((0, 4), np.int32)
        self.links, self.pairs, self.kept = np.zeros(0, np.int32), np.zeros(0, np.int64), 0

    def learn(self, parts: list[str | bytes]) -> None:
        """Align new parts, end to end, as one run of bytes: the ends of parts are common ends."""
        of, a, b, sizes, bad = self.of, [], [], [], []
        for run, raw, ids_a, ids_b in of.encode(parts):
            a += ids_a
            b += ids_b
            if len(run) > 1:
                sizes += [len(p) + 1 for p in run] if raw.isascii() else [len(p.encode()) + 1 for p in run]
            else:
                if not raw:
                    bad.append(len(sizes))
                sizes.append(len(raw))
        ends_a, ends_b, ends = np.cumsum(of.size_a[a]), np.cumsum(of.size_b[b]), np.cumsum(sizes, dtype=np.int64)
        self.kept += int(ends[-1])
        self.number.update(zip(parts, range(len(self.number), len(self.number) + len(parts)), strict=True))
        common, texts, i, j = common_ends(ends_a, ends_b), [], 0, 0
        for _, to_i, to_j in common:
            one = to_i == i + 1 and to_j == j + 1
            texts.append(of.names_a[a[i]] + of.names_b[b[j]] if one else f"{','.join(map(str, a[i:to_i]))}|{','.join(map(str, b[j:to_j]))}")
            i, j = to_i, to_j
        at_link, of_a, of_b = links_of(ends_a, ends_b)
        distinct, links = np.unique(np.array(a, np.int64)[of_a] << 32 | np.array(b, np.int64)[of_b], return_inverse=True)
        numbers = [self.pair_number.setdefault(p, len(self.pair_number)) for p in distinct.tolist()]
        upto = [np.searchsorted(own, ends, "right") for own in (ends_a, ends_b, np.array([e for e, _, _ in common], np.int64), at_link)]
        sizes = np.stack([np.diff(x, prepend=0) for x in upto], 1).astype(np.int32)
        sizes[bad, :3] = -1
        first = 0
        for end in upto[2].tolist():
            self.groups.append(";".join(texts[first:end]))
            first = end
        self.sizes = np.concatenate([self.sizes, sizes])
        self.links = np.concatenate([self.links, np.array(numbers, np.int32)[links]])
        self.pairs = np.concatenate([self.pairs, np.array(list(islice(self.pair_number, len(self.pairs), None)), np.int64)])

    def align(self, texts: list[str | None], keep_groups: bool) -> list[pa.Array]:
        """Columns of COLUMNS for a batch of texts."""
        cut = [[] if not t else [t] if self.of.whole else parts_of(t) for t in texts]
        if len(self.number) > PARTS_KEPT or self.kept > BYTES_KEPT:
            self.clear()
        if new := list({p: 0 for parts in cut for p in parts if p not in self.number}):
            self.learn(new)
        count = np.fromiter(map(len, cut), np.int64, len(cut))
        part = np.fromiter(map(self.number.__getitem__, chain.from_iterable(cut)), np.int64, int(count.sum()))
        doc = np.repeat(np.arange(len(cut)), count)
        sound = np.bincount(doc, self.sizes[part, 0] < 0, len(cut)) == 0
        part, doc = part[sound[doc]], doc[sound[doc]]
        totals = [np.bincount(doc, self.sizes[part, k], len(cut)).astype(np.int64) for k in range(4)]
        ends = np.cumsum(np.where(sound, count, 0))
        named = list(map(self.groups.__getitem__, part.tolist()))
        groups = [";".join(named[end - n : end]) if n and ok else "" for n, ok, end in zip(count.tolist(), sound.tolist(), ends.tolist(), strict=True)]
        digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
        # distinct parts of a document, then their links, then distinct pairs with their links
        both, times = np.unique(doc * len(self.number) + part, return_counts=True)
        doc, part = np.divmod(both, max(1, len(self.number)))
        n = self.sizes[part, 3]
        start = (np.cumsum(self.sizes[:, 3], dtype=np.int64) - self.sizes[:, 3])[part]
        at = np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)
        both, where = np.unique(np.repeat(doc, n) * max(1, len(self.pairs)) + self.links[at], return_inverse=True)
        times = np.bincount(where, np.repeat(times, n), len(both)).astype(np.int32)
        doc, pair = np.divmod(both, max(1, len(self.pairs)))
        offsets = pa.array(np.searchsorted(doc, np.arange(len(cut) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(self.pairs[pair])), pa.ListArray.from_arrays(offsets, pa.array(times))]
        return [*map(pa.array, totals), pa.array(digests, pa.string()), *lists, *([pa.array(groups, pa.string())] if keep_groups else [])]


COLUMNS = ["n_a long", "n_b long", "n_groups long", "n_links long", "groups_sha256 string", "pairs array<long>", "times array<int>"]


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = True) -> DataFrame:
    """Alignment of each row's whole text: (id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times, groups).

    ``groups`` is like ``a1,a2|b1;a3|b2,b3``, left out unless ``keep_groups``; ``pairs`` has the distinct linked pairs as
    a * 2**32 + b and ``times`` the links of each. Null and empty texts, and texts whose bytes either tokenizer doesn't
    give back, have no tokens: zeros, '' and empty lists. Repeated rows stay, ids are of any type, extra columns are
    left behind, an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    columns = [*COLUMNS, *["groups string"] * keep_groups]
    names = [id_col, *[c.split(" ")[0] for c in columns]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = None
        for batch in batches:
            parts = parts or Parts(Tokenizers(path_a, path_b))
            yield pa.RecordBatch.from_arrays([batch.column(0), *parts.align(batch.column(1).to_pylist(), keep_groups)], names)

    given = need(docs, id_col, text_col).select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return given.mapInArrow(run, ", ".join([f"`{id_col}` {type_of(docs, id_col)}", *columns]))


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n, docs, best) from (pair) of each document's distinct pairs: documents with the pair, twice, and whether
    no other pair of the same first id is in more."""
    counts = links.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    most = F.max("n").over(Window.partitionBy(F.shiftright("pair", 32)))
    return counts.select("pair", "n", F.col("n").alias("docs"), (F.col("n") == most).alias("best"))


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row: its alignment and, over its links, the
    sum of the pairs' document counts and the number whose count is the highest of their first id (ties included).

    A row is a document, also where ids repeat. Other cases as in ``aligned``.
    """
    coded = aligned(docs, path_a, path_b, id_col, text_col, keep_groups=False).withColumn("_row", F.monotonically_increasing_id())
    coded = stage(coded, "alignments")
    links = coded.select("_row", F.inline(F.arrays_zip("pairs", "times"))).toDF("_row", "pair", "times")
    counts = stage(pair_counts(links), "alignment-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    counted = join_counted(links, counts, "pair", "n", total, hot_keys=HOT_PAIRS)
    sums = counted.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    plain = coded.select(F.col(f"`{id_col}`"), "_row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
    return plain.join(sums, "_row", "left").select(f"`{id_col}`", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
