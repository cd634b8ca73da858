import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm import bpe as M

pytestmark = pytest.mark.skipif(not os.path.exists(M.vocabulary()), reason="no vocabulary files")


@pytest.fixture(scope="module")
def own():
    return M.coder(M.vocabulary())


@pytest.fixture(scope="module")
def other():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=M.PATTERN, mergeable_ranks=M.coder(M.vocabulary()).ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=80))
def test_like_the_library(own, other, text):
    assert own.encode(text) == other.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text


def test_odd(own, other):
    r = random.Random(1)
    for text in ["", " ", "<|endoftext|>", "a" * 3000, " " * 3000, "\n\r\t 　", "".join(r.choice("abcdefg") for _ in range(5000)), "𝟘日本ñ\x00" * 50, "don't we'll I'VE"]:
        assert own.encode(text) == other.encode_ordinary(text) and own.decode(own.encode(text)) == text


def test_long_piece_is_fast(own):
    import time

    began = time.time()
    own.encode("".join(random.Random(2).choices("abcdefgh", k=300_000)))
    assert time.time() - began < 20


def test_memo_is_bounded(own, monkeypatch):
    monkeypatch.setattr(M, "MEMO", 5)
    fresh = M.BytePairs(M.vocabulary())
    for i in range(50):
        fresh.encode(f"word{i} x")
        assert len(fresh.memo) <= 5


def test_documents(spark, catalog, own):
    texts = [None, "", "   ", "Hello World", "x" * 100_000, "<|endoftext|>"]
    d = catalog(extra="ids int", documents=[{"doc_id": i, "text": t} for i, t in enumerate(texts)])
    got = {r.doc_id: list(r.ids) for r in M.encoded_documents(spark, d).collect()}
    assert got == {i: own.encode(t or "") for i, t in enumerate(texts)}
    assert M.encoded_documents(spark, catalog()).collect() == []


def test_round_trip(spark, data):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{data}/documents.parquet").where("text IS NOT NULL")
    again = docs.select("text", M.decoded(M.token_ids(F.col("text"))).alias("back"), M.token_count(F.col("text")).alias("n"), F.size(M.token_ids(F.col("text"))).alias("m"))
    assert again.where("text <> back OR n <> m").count() == 0
