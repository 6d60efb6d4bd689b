"""The sieve by neighbours (op10): no text that holds a window of an item is left out, most others are."""

from __future__ import annotations

import random
import sys

import numpy as np

from caseflow.llm import decontaminate as D
from caseflow.llm import pairs as P

SF = "/root/testdata/sf0.01"
SIGNS = ["%", "$", "€", "°", ". ", "... ", "\n", "! ", ", ", "_", "-", "\0"]
ODD = ["²", "½", "x²", "İstanbul", "ΟΔΟΣ", "οδος", "ǅem", "Straße", "Éa", "ÉA", "日本", "𝐀b", "A", "Ab", "AB", "aB", "ñ", "ﬁn", "Kelvin", "٣", "3.14", "1,000:5/7", "7..8", "12", "5", "km", "KM", "Km", "kg", "in", "a"]


def holds(spark, items: list[str]):
    """The filter of the items' neighbours, and whether a text holds a window of one of them."""
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = D.benchmark_windows(bench).select("h", "size").distinct().collect()
    wanted = {r.h for r in rows}
    sizes = sorted({r["size"] for r in rows})
    there = lambda t: any(x in wanted for s in sizes for h, _, _ in D.Template(t).windows(s) for x in h.view(np.int64).tolist())
    return D._bits(D.benchmark_pairs(bench)), sizes[0], there


def test_characters_are_those_of_the_words():
    table = P._characters()
    for c in map(chr, range(sys.maxunicode + 1)):
        found = D._TOKEN.fullmatch(c) is not None and c not in ".!?\n"
        assert found == bool(table[ord(c)]), hex(ord(c))
        if found and not table[ord(c)] >> 24 & P._ODD:
            assert chr(table[ord(c)] & 0xFFFFFF) == c.lower() or c.isdecimal()


def test_no_text_with_a_window_is_left_out(spark):
    rng = random.Random(7)
    plain = ["".join(rng.choices("abcdeé", k=3)) for _ in range(12)]
    word = lambda: rng.choice(ODD if rng.random() < 0.3 else plain)
    tail = lambda: rng.choice(SIGNS) if rng.random() < 0.2 else " "
    phrase = lambda n: "".join((word().capitalize() if rng.random() < 0.2 else word()) + tail() for _ in range(n))
    items = [phrase(rng.randrange(8, 20)) for _ in range(60)]

    def changed(text: str) -> str:
        out = text.split(" ")
        for k, w in enumerate(out):
            if rng.random() < 0.1:
                out[k] = rng.choice([w.upper(), w.lower(), w.capitalize(), f"{w}.", f"{w} .", rng.choice(ODD), str(rng.randrange(99))])
        return " ".join(out)

    texts = [phrase(rng.randrange(6)) + changed(rng.choice(items)) + " " + phrase(rng.randrange(6)) for _ in range(3000)] + ["", " ", "5", "a", "x" * P.PIECE, "word " * P.PIECE]
    bits, least, there = holds(spark, items)
    passed = P.passes(texts, least, bits)
    held = np.array([there(t) for t in texts])
    assert 500 < held.sum() < len(texts) and not (held & ~passed).any()
    assert (passed == [P.passes([t], least, bits)[0] for t in texts]).all()  # whatever texts lie beside it


def test_short_items(spark):
    bits, least, there = holds(spark, ["name this bird", "3 + 4 = 7", "alone", "Peter weighs 60 kg now and then"])
    texts = ["Please name this bird now.", "name that bird", "it is 8 + 9", "leave me alone", "Karla weighs 75 lb now and then", "zzz"]
    assert least == 1 and [there(t) for t in texts[:5]] == [True, False, False, True, True]
    assert not any(there(t) and not p for t, p in zip(texts, P.passes(texts, least, bits), strict=True))


def test_texts_of_the_items_words_in_another_order_are_not_taken_apart(spark):
    """Before, every text with eight of the benchmark's words in a row was."""
    rng = random.Random(2)
    items = [" ".join("".join(rng.choices("klmnopqrst", k=5)) for _ in range(30)) for _ in range(20)]
    words = " ".join(items).split()
    texts = [" ".join(rng.sample(words, 60)) for _ in range(200)]
    bits, least, _ = holds(spark, items)
    assert not P.passes(texts, least, bits).any() and P.passes(items, least, bits).all()


def test_few_documents_are_taken_apart(spark):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    bits, least, there = holds(spark, items)
    passed = P.passes(texts, least, bits)
    assert not any(there(t) for t, p in zip(texts, passed, strict=True) if not p)
    assert passed.mean() < 0.15
