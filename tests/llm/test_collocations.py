from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from caseflow.llm import collocations as C

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    """The contract, word by word, with Python's unbounded integers."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = set()
    for lang, counts in f.items():
        cand = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        inside = lambda g, h: any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))
        rows = []
        for g, a in cand.items():
            if any(len(h) > len(g) and 100 * b >= 100 * a and inside(g, h) for h, b in cand.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
            rows.append((" ".join(g), a, counts[g[:k]], counts[g[k:]], n[lang], score))
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out |= {(lang, rank, *r) for rank, r in enumerate(rows[:top], 1)}
    return out


def texts(seed: int, n: int = 300):
    rng = random.Random(seed)
    alphabet = ["a", "B", "c", "é", "中文", "x y", "d ", "Zz", "ß"]
    phrases = [" ".join(rng.choices(alphabet, k=rng.randrange(2, 8))) for _ in range(6)]
    rows = []
    for _ in range(n):
        parts = [rng.choice(phrases) if rng.random() < 0.4 else rng.choice(alphabet + [f"rare{rng.randrange(99)}"]) for _ in range(rng.randrange(30))]
        rows.append((rng.choice(["en", "de", None, "und", ""]), "".join(p + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "\x0b", ",", "\r\n"]) for p in parts)))
    return rows + [("en", None), ("en", ""), (None, " . , \t"), ("fr", "one two")]


@pytest.mark.parametrize("seed,least,top,chunk,filtered", [(1, 5, 2000, 4 << 20, 3), (2, 2, 7, 500, 1), (3, 1, 2000, 1, 5)])
def test_equals_counting_every_phrase(spark, monkeypatch, seed, least, top, chunk, filtered):
    """Chunks of any size, in which a piece may be larger than a chunk, and any number of filters give the same counts."""
    monkeypatch.setattr(C, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(C, "HELD_KEYS", 10 if chunk < 10_000 else C.HELD_KEYS)
    monkeypatch.setattr(C, "HELD_WINDOWS", 10 if chunk < 10_000 else C.HELD_WINDOWS)
    monkeypatch.setattr(C, "FILTERED", filtered)
    rows = texts(seed, 300 if least > 1 else 60)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = [tuple(r) for r in C.collocations(df, least, top).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, least, top)


def test_empty_table_clashing_names_and_repeated_rows(spark):
    df = spark.createDataFrame([], "text string, lang string, n int")
    assert C.collocations(df, 1).collect() == []
    rows = [("en", "good morning all")] * 50
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "lang string, text string, n int, key int, w1 string")
    assert [tuple(r) for r in C.collocations(df, 50).collect()] == [("en", 1, "good morning all", 50, 50, 50, 150, 3000)]


def test_one_language_holds_all_and_counts_pass_64_bits(spark):
    """Products of counts are exact beyond 64 bits."""
    frame = spark.createDataFrame([("en", 0, "", 9_000_000_000_000_000_001), ("en", 1, "p", 4_000_000_007), ("en", 1, "q", 4_000_000_009), ("en", 2, "p q", 4_000_000_003)], "lang string, size int, phrase string, n long")
    try:
        kept, C.phrase_counts = C.phrase_counts, lambda *a: frame
        row = C.collocations(spark.createDataFrame([], "text string, lang string")).collect()[0]
    finally:
        C.phrase_counts = kept
    assert row.score == 1000 * 4_000_000_003 * 9_000_000_000_000_000_001 // (4_000_000_007 * 4_000_000_009)


def test_false_hits_of_the_filters_change_nothing(spark, monkeypatch):
    """With filters that let everything pass, windows are longer and the result is the same."""
    rows = texts(5)
    df = spark.createDataFrame(rows, "lang string, text string")
    want = {tuple(r) for r in C.collocations(df, 4).collect()}
    import numpy as np

    monkeypatch.setattr(C, "frequent_keys", lambda *a: np.full(1 << 10, 255, np.uint8))
    assert {tuple(r) for r in C.collocations(df, 4).collect()} == want == brute(rows, 4, 2000)


def test_long_text_is_cut_between_pieces():
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array(["ab cd. " * 3_000_000])], ["lang", "text"])
    parts = [raw for _, raw in C.chunks(iter([batch]))]
    assert len(parts) > 3 and max(map(len, parts)) <= C.CHUNK_BYTES
    assert sum(len(C.Words(p, "en").ids) for p in parts) == 6_000_000
