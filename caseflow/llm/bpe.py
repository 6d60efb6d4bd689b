"""Byte-level BPE: a recursive DuckDB query in each partition contracts words; ordered aggregation decodes.

Texts are split by the tokenizer's pattern. Each new word becomes token-position rows, first one per byte; a recursive
step joins neighbouring rows to the merge table and contracts the leftmost pair of least rank of every word, until no
word has a pair left. Words are kept for a while, so each is contracted about once in a partition. Words over
``LONG_BYTES`` bytes would make the recursion quadratic; an exact merge with a heap handles those. Decoding takes each
document's own ids: its token-position rows join the vocabulary, and pieces are aggregated in order.
"""

from __future__ import annotations

import base64
import ctypes
import gc
import hashlib
import heapq
import re
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import need, small_batches, with_text

LONG_BYTES = 64
#: Words whose ids a task keeps; memory of a task's DuckDB. Both go with the task.
WORDS_KEPT, MEMORY = 500_000, "128MB"
#: Texts are encoded in groups of about this many characters; a query contracts words of at most this many squared bytes
#: in all (what the recursion keeps grows with them), and decodes at most this many tokens, in runs of at most RUN.
GROUP_CHARS, QUERY_SQUARES, QUERY_TOKENS, RUN = 1_000_000, 8_000_000, 1 << 18, 1 << 16

#: token-position rows of each word meet the merge table; the least (rank, position) of a word is contracted.
#: Row 255 of a list can't occur: longer words go through the heap.
_CONTRACT = """
WITH RECURSIVE parts(step, word, ids) AS (
  SELECT 0, word, ids FROM bytes_of
  UNION ALL
  SELECT step + 1, word, list_concat(list_append(ids[:(pick & 255) - 1], (pick >> 8)::INT), ids[(pick & 255) + 2:])
  FROM parts JOIN (
    SELECT word, min((merged::BIGINT << 8) | pos) AS pick
    FROM (SELECT word, unnest(ids[:-2]) AS a, unnest(ids[2:]) AS b, generate_subscripts(ids[2:], 1) AS pos FROM parts)
    JOIN merges USING (a, b) GROUP BY word) USING (word)),
 done AS (SELECT word, arg_max(ids, step) AS ids FROM parts GROUP BY word)
SELECT word, array_to_string(ids, ',') AS ids FROM done
"""
#: Every cut of a token into two tokens is a merge whose result is that token.
_MERGES = """
CREATE TABLE merges AS SELECT l.id AS a, r.id AS b, t.id AS merged
FROM (SELECT id, piece, unnest(range(1, length(piece))) AS k FROM vocabulary WHERE length(piece) > 1) AS t
JOIN vocabulary AS l ON l.piece = substring(t.piece, 1, t.k) JOIN vocabulary AS r ON r.piece = substring(t.piece, t.k + 1)
"""
#: token-position rows of each run meet the vocabulary; pieces hold a character for each byte.
_DECODE = "SELECT run, array_to_string(list(piece ORDER BY pos), '') AS decoded FROM coded JOIN vocabulary USING (id) GROUP BY run"
#: The pattern of the public rank files (a fixed value), and its classes spelled out for code points below U+0250,
#: where the built-in regular expressions are faster.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\\t-\\r \\x85\\xa0"
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+").findall
_BEYOND = re.compile("[^\x00-ɏ]").search


def splitter(pattern: str):
    """Function that splits a text into the pattern's matches."""
    every = regex.compile(pattern).findall
    if pattern != PATTERN:
        return every
    return lambda text: every(text) if _BEYOND(text) else _LATIN(text)


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a tiktoken rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word of any length: the same contractions through a heap of (rank, place)."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n

    def rank(i: int) -> int | None:
        j = end[i]
        return ranks.get(word[i : end[j]]) if j < n else None

    heap = [(r, i, end[i + 1]) for i in range(n - 1) if (r := rank(i)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        alive[j] = False
        end[i] = end[j]
        if end[i] < n:
            before[end[i]] = i
        for k in (i, before[i]):
            if k >= 0 and alive[k] and (r := rank(k)) is not None:
                heapq.heappush(heap, (r, k, end[end[k]]))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Ids(dict):
    """Ids of words, as text; those of whole vocabulary entries come from the ranks when asked for."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks

    def __missing__(self, word: str) -> str:
        self[word] = str(self.ranks[word.encode("utf-8", "replace")])
        return self[word]


class Encoder:
    """Encodes and decodes whole texts with one rank file; holds a DuckDB connection, so it stays in its task."""

    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        self.ranks = load_ranks(path)
        self.split = splitter(pattern)
        #: ids of each word met lately, as text
        self.kept: dict[str, str] = Ids(self.ranks)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})  # nothing spills to a local disk
        ids, pieces = np.fromiter(self.ranks.values(), np.int32, len(self.ranks)), pa.array([t.decode("latin-1") for t in self.ranks])
        self._table("vocabulary", {"id": pa.array(ids), "piece": pieces})
        self.db.execute(_MERGES)

    def close(self) -> None:
        """Give all memory back; workers outlive tasks, and other stages need it."""
        self.db.close()
        self.ranks, self.kept = {}, Ids({})
        gc.collect()
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # a C library without it
            ctypes.CDLL(None).malloc_trim(0)

    def _table(self, name: str, columns: dict[str, pa.Array]) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _ask(self, name: str, columns: dict[str, pa.Array], query: str) -> pa.Table:
        self.db.register(name, pa.table(columns))
        found = self.db.sql(query).to_arrow_table()
        self.db.unregister(name)
        return found

    def learn_words(self, words: set[str]) -> None:
        """Add the ids of new words to those kept."""
        rank, asked, start, squares = self.ranks, [], [], 0
        for w in words:
            raw = w.encode("utf-8", "replace")
            if (whole := rank.get(raw)) is not None:
                self.kept[w] = str(whole)
            elif len(raw) > LONG_BYTES:
                self.kept[w] = ",".join(map(str, merge_bytes(raw, rank)))
            else:
                asked.append(w)
                start.append([rank[raw[i : i + 1]] for i in range(len(raw))])
                squares += len(raw) ** 2
                if squares > QUERY_SQUARES:
                    self._contract(asked, start)
                    asked, start, squares = [], [], 0
        if asked:
            self._contract(asked, start)

    def _contract(self, words: list[str], start: list[list[int]]) -> None:
        found = self._ask("bytes_of", {"word": pa.array(range(len(words)), pa.int32()), "ids": pa.array(start, pa.list_(pa.int32()))}, _CONTRACT)
        for k, ids in zip(found.column("word").to_pylist(), found.column("ids").to_pylist(), strict=True):
            self.kept[words[k]] = ids

    def encode(self, texts: list[str]) -> list[str]:
        """Ids of each text, joined by commas, as ordinary text: special tokens have no meaning."""
        pieces = [self.split(t) for t in texts]
        if len(self.kept) > WORDS_KEPT:
            self.kept.clear()
        new = {w for p in pieces for w in p if w not in self.kept}
        if new:
            self.learn_words(new)
        return [",".join(map(self.kept.__getitem__, p)) for p in pieces]

    def decode(self, lists: list[np.ndarray]) -> list[bytes]:
        """Bytes of each id list: ids joined to the vocabulary, pieces aggregated in their order, in runs of a list."""
        out: list[list[bytes]] = [[] for _ in lists]
        runs = [(k, ids[at : at + RUN]) for k, ids in enumerate(lists) for at in range(0, len(ids), RUN)]
        while runs:
            ends = np.cumsum([len(ids) for _, ids in runs[:QUERY_TOKENS]])
            part = runs[: max(1, int(np.searchsorted(ends, QUERY_TOKENS, "right")))]
            runs = runs[len(part) :]
            flat = np.concatenate([ids for _, ids in part]).astype(np.int32)
            run = np.repeat(np.arange(len(part), dtype=np.int32), [len(ids) for _, ids in part])
            found = self._ask("coded", {"run": pa.array(run), "pos": pa.array(np.arange(len(flat), dtype=np.int32)), "id": pa.array(flat)}, _DECODE)
            decoded = dict(zip(found.column("run").to_pylist(), found.column("decoded").to_pylist(), strict=True))
            for r, (k, _) in enumerate(part):
                out[k].append(decoded.get(r, "").encode("latin-1"))
        return [b"".join(x) for x in out]

    def code(self, texts: list[str]) -> Iterator[tuple[int, str, bytes]]:
        """For each text the number of its ids, these ids joined by commas, and the bytes that they decode to."""
        coded = self.encode(texts)
        lists = [parse_ids(x) for x in coded]
        for ids, own, raw in zip(lists, coded, self.decode(lists), strict=True):
            yield len(ids), own, raw


def parse_ids(ids: str) -> np.ndarray:
    """Ids that are joined by commas."""
    return np.fromstring(ids, np.int32, sep=",") if ids else np.zeros(0, np.int32)


def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


@contextmanager
def encoding(path: str, pattern: str) -> Iterator[Encoder]:
    """An encoder that lives as long as the block: as a task of an iterator's function."""
    encoder = _encoder(path, pattern)
    try:
        yield encoder
    finally:
        encoder.close()


def _groups(texts: list[str]) -> Iterator[slice]:
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= GROUP_CHARS:
            yield slice(start, k + 1)
            start, size = k + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def encode_tokens(docs: DataFrame, path: str, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) per row of ``docs``; a null text is an empty one and has no ids.

    Repeated rows stay, ids are of any type, extra columns are left behind, an empty table gives an empty result."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with encoding(path, pattern) as encoder:
            for batch in batches:
                texts = [t or "" for t in batch]
                yield pd.Series([parse_ids(x) for at in _groups(texts) for x in encoder.encode(texts[at])])

    out = need(docs, id_col, text_col)
    return out.select(F.col(f"`{id_col}`"), ids(F.col(f"`{text_col}`").cast("string")).alias("ids"))


def decode_tokens(coded: DataFrame, path: str, pattern: str = PATTERN, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes binary) per row of ``coded``; null or empty ids give empty bytes. An unknown id adds nothing."""
    small_batches(coded.sparkSession)

    @F.pandas_udf("binary")
    def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with encoding(path, pattern) as encoder:
            for ids in batches:
                yield pd.Series(encoder.decode([np.zeros(0, np.int32) if x is None else np.asarray(x, np.int32) for x in ids]))

    return need(coded, id_col, ids_col).select(F.col(f"`{id_col}`"), raw(F.col(f"`{ids_col}`")).alias("bytes"))


def digest_tokens(docs: DataFrame, path: str, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) per row: texts are encoded, and the ids decoded, in one pass.

    A null text is an empty one; a text of any length is taken whole, its ids decoded in runs. Repeated rows stay, ids
    are of any type, extra columns are left behind, and an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with encoding(path, pattern) as encoder:
            for batch in batches:
                out, texts = [], [t or "" for t in batch]
                for at in _groups(texts):
                    out += [(n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(raw).hexdigest()) for n, ids, raw in encoder.code(texts[at])]
                yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    out = need(docs, id_col, text_col)
    out = out.select(F.col(f"`{id_col}`"), digest(F.col(f"`{text_col}`").cast("string")).alias("_d"))
    return out.select(f"`{id_col}`", "_d.n_tokens", "_d.ids_sha256", "_d.decoded_sha256")


def with_tokens(docs: DataFrame, path: str, pattern: str = PATTERN, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``n_tokens`` and ``token_ids`` (decimal ids joined by commas); the text is the one decoded from
    these ids. A null text becomes an empty one. Columns of these names that ``docs`` already has are replaced."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("n_tokens long, token_ids string, text string")
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with encoding(path, pattern) as encoder:
            for batch in batches:
                out, given = [], [t or "" for t in batch]
                for at in _groups(given):
                    out += [(n, ids, raw.decode("utf-8", "replace")) for n, ids, raw in encoder.code(given[at])]
                yield pd.DataFrame(out, columns=["n_tokens", "token_ids", "text"])

    return with_text(docs, text_col, code, {"n_tokens": "n_tokens", "token_ids": "token_ids"})
