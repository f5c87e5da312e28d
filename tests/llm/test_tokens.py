import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import tokens as K

pytestmark = pytest.mark.skipif(not os.path.exists(K.vocabulary_file("byte_bpe_50k")), reason="no tokenizer files")

TEXTS = [
    None, "", " ", "\n\n", "Hello world's  end\t<|endoftext|> ", "naïve 😀 数字１２ x y", "'re ''s 'S don't", "a" * 5000, "\x1c \u0085x", "tab\t\t\n  z", "same words same words", "​﻿1²₂",
]


def test_against_the_library(spark):
    df = spark.createDataFrame([(i, t, "clash", [1]) for i, t in enumerate(TEXTS)], "doc_id long, text string, word string, ids array<int>")
    got = {r.doc_id: list(r.ids) for r in K.encode(df).collect()}
    enc = K.text_encoder("byte_bpe_50k")
    assert got == {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.text for r in K.decode(K.encode(df)).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.n_tokens for r in K.count_tokens(df).collect()} == {i: len(x) for i, x in got.items()}


def test_rare_words_are_joined(spark, monkeypatch):
    monkeypatch.setattr(K, "FREQUENT", 0.2)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    enc = K.text_encoder("byte_bpe_50k")
    assert {r.doc_id: list(r.ids) for r in K.encode(df).collect()} == {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}


def test_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(K, "FREQUENT", 0.9)  # every word is rare
    rows = [(1, "old words here", "2025-01-01"), (1, "the newer wall text", "2025-02-01"), (1, "the newer wall text", "2025-02-01"), (1, "no time", None), (2, "x y", None), (3, "", "2025-01-01"), (3, None, "2024-01-01")]
    df = spark.createDataFrame(rows, "doc_id long, text string, at string").selectExpr("doc_id", "text", "cast(at as timestamp) AS received_at")
    enc = K.text_encoder("byte_bpe_50k")
    want = [(1, enc.encode_ordinary("the newer wall text")), (2, enc.encode_ordinary("x y")), (3, [])]
    assert sorted((r.doc_id, list(r.ids)) for r in K.encode(df).collect()) == want
    untimed = K.encode(df.drop("received_at").union(df.drop("received_at")))
    assert untimed.count() == 3
    ids = K.encode(df)
    assert sorted((r.doc_id, r.text) for r in K.decode(ids.union(ids)).collect()) == [(1, "the newer wall text"), (2, "x y"), (3, "")]


def test_empty_table_and_string_keys(spark):
    df = spark.createDataFrame([("k", "a b"), (None, "x")], "doc_id string, text string")
    assert [r.doc_id for r in K.encode(df).collect()] == ["k"]
    assert K.encode(df.limit(0)).count() == 0 and K.decode(K.encode(df.limit(0))).count() == 0


def test_library_file_agrees():
    tokenizers = pytest.importorskip("tokenizers")
    path = os.path.join(K.TOKENIZERS, "byte_bpe_50k.json")
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    enc = K.text_encoder("byte_bpe_50k")
    for x in filter(None, TEXTS):
        assert t.encode(x, add_special_tokens=False).ids == enc.encode_ordinary(x)


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60))
def test_pieces(text):
    """A piece encoded by itself is what the library makes of it within a text."""
    import regex

    pieces = regex.findall(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", text)
    if "".join(pieces) == text and text.isprintable():
        enc = K.text_encoder("byte_bpe_50k", pattern=K.PIECE)
        assert [i for p in pieces for i in enc.encode_ordinary(p)] == K.text_encoder("byte_bpe_50k").encode_ordinary(text)
