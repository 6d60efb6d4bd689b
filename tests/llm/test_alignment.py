from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from caseflow.llm import alignment as A

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATH_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATH_B)


def spans(tokens):
    out, at = [], 0
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


def document(text, libraries):
    """Ids, links and groups string of a whole text, from the libraries' own results, by comparing all byte ranges."""
    a, b = libraries
    if not text:
        return None
    raw = (" " + text).encode()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    letters = A.byte_letters()
    bytes_a = [bytes(letters[c] for c in a.id_to_token(k)) for k in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return None
    at_a, at_b = spans(bytes_a), spans(bytes_b)
    links = [(x, y) for x, (s, e) in zip(ids_a, at_a, strict=True) for y, (t, f) in zip(ids_b, at_b, strict=True) if max(s, t) < min(e, f)]
    common, groups, start = sorted({e for _, e in at_a} & {e for _, e in at_b}), [], 0
    for end in common:
        inside = lambda ids, at: ",".join(str(k) for k, (s, e) in zip(ids, at, strict=True) if start <= s and e <= end)  # noqa: E731, B023
        groups.append(f"{inside(ids_a, at_a)}|{inside(ids_b, at_b)}")
        start = end
    return ids_a, ids_b, links, groups


def brute(texts, libraries):
    found = [document(t, libraries) for t in texts]
    docs = Counter(p for d in found if d for p in set(d[2]))
    most = {}
    for (x, _), n in docs.items():
        most[x] = max(most.get(x, 0), n)
    rows = []
    for d in found:
        if d is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, links, groups = d
        rows.append((len(a), len(b), len(groups), len(links), sum(docs[p] == most[p[0]] for p in links), sum(docs[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return rows


def odd_texts(seed, n):
    rng = random.Random(seed)
    marks = ["\n", "\t", " ", "  ", "   ", " ", "\u00a0", "\u200b", "\u2581", "\u0000", "\u001c", "\u0085", "\ufeff", "\u3000", "\u0301", "\u00ad", "\r\n"]
    words = ["the", "Übergrößen", "don't", "'s", "1234567", "x=1;", "<|endoftext|>", "<s>", "<unk>", "<0x41>", "日本語", "😀", "é", "a" * 70, "नमस्ते", "...", "a.b,", "x².", "ß;!", "7:", "—", "”"]
    return ["".join(rng.choice(words if rng.random() < 0.6 else marks[:8] if rng.random() < 0.9 else marks) + rng.choice(["", "", " "]) for _ in range(rng.randrange(1, 14))) for _ in range(n)]


def test_equals_comparing_all_byte_ranges(spark, libraries):
    texts = odd_texts(1, 400) + [None, "", " ", "  ", "a", " a", "a ", "\n", "a  b", "a\n  b", "same words here"] + ["same words here"] * 9
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in A.align_tokenizers(df, PATH_A, PATH_B).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts, libraries)
    assert sum(g[0] > 0 for g in got.values()) > 250


def test_given_documents(spark, libraries):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    got = [tuple(r)[1:] for r in A.align_tokenizers(docs, PATH_A, PATH_B).orderBy("doc_id").collect()]
    assert got == [(*r,) for r in brute(texts, libraries)]


def test_parts_and_whole_texts_agree(libraries):
    """Cutting a text changes neither tokenizer's ids."""
    of = A.Tokenizers(PATH_A, PATH_B)
    assert not of.whole
    for text in odd_texts(7, 3000):
        if "▁" in text or "\u0000" in text:  # one of the tokenizers doesn't give these back
            continue
        parts = A.parts_of(text)
        assert "".join(p.decode() if isinstance(p, bytes) else " " + p for p in parts) == " " + text
        runs = list(of.encode(parts))
        assert [p for run, *_ in runs for p in run] == parts and b"".join(raw for _, raw, _, _ in runs).decode() == " " + text
        assert [x for *_, a, _ in runs for x in a] == of.a.encode(" " + text, add_special_tokens=False).ids, text
        assert [x for *_, b in runs for x in b] == of.b.encode(text), text


def test_forgetting_parts_and_whole_text_mode_change_nothing(monkeypatch):
    texts = odd_texts(3, 50)
    plain = A.Parts(A.Tokenizers(PATH_A, PATH_B))
    want = [c.to_pylist() for c in plain.align(texts, True)]
    monkeypatch.setattr(A, "PARTS_KEPT", 0)
    for whole in (False, True):
        other = A.Parts(A.Tokenizers(PATH_A, PATH_B))
        other.of.whole = whole
        got = [[x for t in texts for x in other.align([t], True)[k].to_pylist()] for k in (0, 1, 2, 3, 4, 7)]
        assert got == [want[k] for k in (0, 1, 2, 3, 4, 7)]


def test_repeated_rows_any_ids_clashing_names_and_a_very_long_text(spark, libraries):
    long = "word and 12 words " * 60_000
    df = spark.createDataFrame([("x", "two words", 1), ("x", "two words", 2), (None, "two other words", 3), ("y", long, 4), ("z", "ab" * 100_000, 5)], "doc_id string, text string, pairs int").withColumn("n_a", F.lit("clash"))
    rows = {(r.doc_id, r.n_a, r.groups_sha256): r for r in A.align_tokenizers(df, PATH_A, PATH_B).collect()}
    assert len(rows) == 4 and next(r for r in rows.values() if r.doc_id == "y").n_a == 4 * 60_000 + 1
    assert next(r for r in rows.values() if r.doc_id == "x").count_sum == 3 + 4  # rows with " two", with " words"
    assert A.align_tokenizers(df.limit(0), PATH_A, PATH_B).count() == 0


def test_common_and_rare_pairs_meet_their_counts(spark, libraries, monkeypatch):
    """Both ways of joining the counts are taken."""
    monkeypatch.setattr(A, "HOT_PAIRS", 20)
    texts = odd_texts(5, 120)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [tuple(r)[1:] for r in A.align_tokenizers(df, PATH_A, PATH_B).orderBy("doc_id").collect()]
    assert got == brute(texts, libraries)
