from __future__ import annotations

import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from caseflow.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", "a" * 5000 + "!" * 300, "  \n\n x  ", "日本語テキスト🎉", "<|endoftext|> hi", "\x00\x01é\x1c\x1d", "İıß ǅ don't we'll", " ​\xa0\xa0x", "ünïcödé " * 3000]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(PATH, P.PATTERN)


def test_like_the_library(encoder, library):
    ids = [bpe.parse_ids(x) for x in encoder.encode(ODD)]
    assert [x.tolist() for x in ids] == [library.encode_ordinary(t) for t in ODD]
    assert encoder.decode(ids) == [t.encode() for t in ODD]


def test_runs_and_queries_of_any_size(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "RUN", 7)
    monkeypatch.setattr(bpe, "QUERY_TOKENS", 20)
    monkeypatch.setattr(bpe, "QUERY_SQUARES", 100)
    encoder.kept = {}
    ids = [bpe.parse_ids(x) for x in encoder.encode(ODD)]
    assert [x.tolist() for x in ids] == [library.encode_ordinary(t) for t in ODD]
    assert encoder.decode([x[:500] for x in ids]) == [library.decode_bytes(x[:500].tolist()) for x in ids]


def test_decoding_reads_the_ids():
    """A wrong id of a word shows in the decoded bytes, also where the word is an entry of the vocabulary."""
    encoder = bpe.Encoder(PATH, P.PATTERN)
    encoder.kept[" the"] = encoder.kept["!"]
    assert [raw for _, _, raw in encoder.code(["see the cat"])] == [b"see! cat"]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    encoder, library = bpe._encoder(PATH, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    assert bpe.parse_ids(encoder.encode([text])[0]).tolist() == library.encode_ordinary(text)


def test_heap_and_query_agree(encoder):
    words = ["unbelievable", " zzzqqqxx", "ñandúes", "aaaaaaaaaaaaaaaaab"]
    encoder.kept = {}
    encoder.learn_words(set(words))
    assert all(encoder.kept[w] == ",".join(map(str, bpe.merge_bytes(w.encode(), encoder.ranks))) for w in words if w.encode() not in encoder.ranks)


def test_digests(spark, library):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "x y"), (99, None), (99, None)]
    df = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, n_tokens int")
    got = bpe.digest_tokens(df, PATH, P.PATTERN).collect()
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    coded = bpe.encode_tokens(df, PATH, P.PATTERN)
    assert {bytes(r.bytes) for r in bpe.decode_tokens(coded, PATH, P.PATTERN).collect()} == {(t or "").encode() for _, t in rows}
    kept = bpe.with_tokens(df, PATH, P.PATTERN)
    assert set(kept.columns) == {"doc_id", "text", "n_tokens", "token_ids"}
    clash = df.toDF("_coded", "text", "TOKEN_IDS")
    assert bpe.with_tokens(clash, PATH, P.PATTERN).columns == ["_coded", "text", "n_tokens", "token_ids"]
    assert {r.text for r in bpe.with_tokens(clash, PATH, P.PATTERN).collect()} == {t or "" for _, t in rows}
    assert bpe.digest_tokens(df.limit(0), PATH, P.PATTERN).count() == 0
