"""Splitting, merging and counting against the tokenizers library itself."""

import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from growthcast.llm import tokens as T

PATH = T.tokenizer_path()
ODD = ["", " ", "  ", "\n\n x", "it's I'll we'VE", "a\u00a0b\u3000c\x85d\x1ce\u200bf", "<|endoftext|>", " x<|endoftext|> y<|endoftext|><|endoftext",
       "12½ ²x", "日本語のテキスト です", "e\u0301e\u0301 ä", "\x00\x01\x7f", "😀👩‍👩‍👧 x", "\t\t\tif x:\r\n\r\n  y", "ab" * 5000, "   trailing   ", "\ufeffbom"]


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


def ids(lib, text):
    return lib.encode(text, add_special_tokens=False).ids


def test_every_code_point_splits_as_the_library_does(lib):
    split = T.Splitter(PATH)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 997):
        text = "".join(f"a{c}b 1{c}2 {c} {c}{c}" for c in points[i:i + 997])
        assert [x for w in split(text) for x in split.merge(w)] == ids(lib, text)


def test_random_texts(lib):
    split, rng = T.Splitter(PATH), random.Random(5)
    letters = "ab'sXé 1½ \n\t\u00a0.,-日😀"
    for text in ODD + ["".join(rng.choices(letters, k=rng.randrange(80))) for _ in range(3000)]:
        assert [x for w in split(text) for x in split.merge(w)] == ids(lib, text)


def test_single_tokens_are_proven(lib):
    single = T.single_tokens(PATH)
    assert 45_000 < len(single) < 50_257
    for w in random.Random(1).sample(sorted(single), 500):
        assert len(ids(lib, w)) == 1


def test_counts_match_the_library(spark, sf, lib):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (0, "twice"), (0, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash")).withColumn("n_bytes", F.lit(1))
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in T.count_tokens(df).collect())
    assert got == sorted((i is not None, i or 0, len((t or "").encode()), n := len(ids(lib, t or "")), n > 512) for i, t in rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: len(ids(lib, r.text or "")) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in T.count_tokens(docs).collect()} == want
    assert T.count_tokens(df.limit(0)).count() == 0
