"""Token counts and packing against the tokenizers library itself."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from depthloom.llm import bpe, packing
from depthloom.llm.token_counts import token_counts

NAME = "byte_bpe_50k.json"
TRICKY = [
    "", " ", "  ", "a", "a  b", "a   b", "\n\n\tx", "a\n\t\tb", "a\r\n\r\nb", " lead", "trail ", "trail\n", "a\t\nb", "x   y", "<|endoftext|>", "a <|endoftext|> b\nc<|endoftext|>d",
    "don't we'll it's", "naïve Über 你好 🙂🙂", "#### $$$ a1b22", "word " * 50, "Ünï\ncode line\nthird one", "a" * 5000,
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(NAME))
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def test_counts_and_ids_equal_the_library(library):
    merges, ids = bpe.merger(NAME), bpe.Encoder(public_tokenizers.path(NAME))
    for text in TRICKY:
        assert merges.count(text) == len(library(text)), repr(text)
    for text, got in zip(TRICKY, ids.encode(TRICKY)):
        assert np.frombuffer(got, ids.kind).tolist() == library(text), repr(text)


def test_encoders_that_must_go_through_the_library(library):
    fast = bpe.encoder(NAME)
    assert fast.fast is not None
    for text in (" " * 250_000 + "x", "a" * 200_000, "é" * 30_000, "\n" * 250_000):
        assert np.frombuffer(fast.one(text), fast.kind).tolist() == library(text)
    other = bpe.encoder("word_bpe_49k.json")
    assert other.fast is None and other.one("Two words") == other.whole("Two words")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*"ab'sé \n\t\r1#<|>", "\u00a0", "<|endoftext|>"]), max_size=30).map("".join))
def test_any_text_equals_the_library(library, text):
    assert bpe.merger(NAME).count(text) == len(library(text))
    assert np.frombuffer(bpe.encoder(NAME).encode([text])[0], "<u2").tolist() == library(text)


def test_token_counts_edges(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(TRICKY)] + [(None, "null id", "x"), (7, None, "x"), (7, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")  # a clashing extra column
    got = [tuple(r) for r in token_counts(docs).collect()]
    want = [(i, len((t or "").encode()), len(library(t or "")), len(library(t or "")) > 512) for i, t, _ in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert token_counts(docs.limit(0)).count() == 0


def test_packing_round_trip(spark, library):
    texts = TRICKY + [None, "long " * 4000, "b " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    pieces = packing.pack(docs)
    rows = sorted(pieces.collect(), key=lambda r: (r["doc_id"], r["start"]))
    for i, text in enumerate(texts):
        own = [r for r in rows if r["doc_id"] == i]
        want = library(text or "") + [1]
        assert np.concatenate([np.frombuffer(r["ids"], "<u4") for r in own]).tolist() == want
        assert {r["doc_tokens"] for r in own} == {len(want)}
        assert [r["start"] for r in own] == np.cumsum([0] + [r["length"] for r in own])[:-1].tolist()
    stream = sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))
    place = 0
    for r in stream:  # gapless, and only the last sequence is short
        assert r["sequence_id"] * 2048 + r["offset"] == place and 0 < r["length"] and r["offset"] + r["length"] <= 2048
        place += r["length"]
    first = packing.digest(pieces).filter("doc_id = 3 and start = 0").first()
    assert first["ids_crc32"] == zlib.crc32(np.array((library("a") + [1])[: first["length"]], "<u4").tobytes())
    assert packing.pack(docs.limit(0)).count() == 0
    built = packing.sequences(pieces).agg(F.sum("n_tokens"), F.max("n_tokens")).first()
    assert built[0] == place and built[1] <= 2048


def test_packing_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "same"), (1, "same"), (None, "x")], "doc_id long, text string")
    got = {r["doc_id"]: r["n"] for r in packing.pack(docs).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert got == {1: 4, None: 2}
