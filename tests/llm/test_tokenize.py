"""Exact ids, against a public implementation."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm import tokenize


@pytest.fixture(scope="module")
def both(vocabulary):
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(vocabulary)
    reference.encode_special_tokens = True
    return tokenize.Codec(vocabulary), lambda texts: [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]


ODD = [
    "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b", "a\n b", "\xa0a", "a \xa0 \xa0 b", "a　b c", "<|endoftext|> x<|endoftext|>", "don't we'll I'VE it's 's", "x²y ½ 12 ١٢",
    "日本語のテキスト。", "🙂🙃👩‍👩‍👧", "é ​‍﻿", "\x00\x01\x1c\x85", "a" * 5_000, "ab" * 3_000, " " * 3_000, "日" * 3_000, "-=" * 2_000, "\t\t\tx", "x\r\n\r\ny",
]


def test_odd_texts(both):
    mine, reference = both
    assert [mine.encode(t) for t in ODD] == reference(ODD)
    assert mine.encode(None) == []


def test_random_mixtures(both):
    mine, reference = both
    r = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "\xa0", " ", "a", "the", "The", "ing", "'s", "'ll", "12", "é", "日本", "🙂", "!!", "…", "​", "²", "\x00", "\x1c", "\x85"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(4_000)]
    assert [mine.encode(t) for t in texts] == reference(texts)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(both, text):
    mine, reference = both
    assert mine.encode(text) == reference([text])[0]


def test_memory_that_starts_anew(both, monkeypatch):
    mine, reference = both
    monkeypatch.setattr(tokenize, "WORDS", 5)
    texts = ["one two three four five six seven eight one two \n\n three"] * 3
    assert [mine.encode(t) for t in texts] == reference(texts)


def test_column(both, spark):
    rows = [(1, "Hello world", 5), (2, None, None), (3, "", 1), (1, "Hello world", 5), (None, "x", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = [(r["doc_id"], r["ids"]) for r in tokenize.encode(df).collect()]
    hello = both[0].encode("Hello world")
    assert sorted(got, key=repr) == sorted([(1, hello), (2, []), (3, []), (1, hello), (None, both[0].encode("x"))], key=repr)
    counts = [(r["doc_id"], r["n_tokens"]) for r in tokenize.count_tokens(df).collect()]
    assert sorted(counts, key=repr) == sorted([(i, len(x)) for i, x in got], key=repr)
    assert tokenize.encode(df.limit(0)).count() == 0


def test_all_documents(both, spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    got = {r["doc_id"]: r["ids"] for r in tokenize.encode(df).collect()}
    assert got == dict(zip(texts, both[1]([t or "" for t in texts.values()]), strict=True))
