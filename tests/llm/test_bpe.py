"""Encoding and decoding against the tokenizers library."""

import hashlib

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from growthcast.llm import bpe as B, queries as Q
from growthcast.llm.tokens import tokenizer_path
from test_tokens import ODD


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(tokenizer_path())


def want(lib, i, text):
    ids = lib.encode(text or "", add_special_tokens=False).ids
    return i, ids, lib.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("chunk", [B.CHUNK, 60])
def test_edges(spark, lib, chunk):
    rows = [*enumerate(ODD), (None, None), (None, "x y"), (1, "twice"), (1, "twice"), (99, "long \n" * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("chunk", F.lit(1)).repartition(3)
    got = sorted(((r.doc_id, list(r.ids), r.decoded) for r in B.encode(df, chunk=chunk).collect()), key=str)
    assert got == sorted((want(lib, *r) for r in rows), key=str)
    assert B.encode(df.limit(0)).count() == 0


def test_tasks_of_many_chunks_keep_their_words_apart(spark, lib):
    """Every text is a chunk of its own, 300 and more in each of two tasks."""
    rows = [(i, f"word{i} and {i * 7919}") for i in range(640)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id long, text string")
    got = sorted((r.doc_id, list(r.ids), r.decoded) for r in B.encode(df, chunk=1).collect())
    assert got == [want(lib, *r) for r in rows]


def test_query(spark, sf, lib):
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        i, ids, text = want(lib, r.doc_id, r.text)
        expected.add((i, len(ids), digest(",".join(map(str, ids))), digest(text)))
    assert {tuple(r) for r in Q.QUERIES["op3_bpe_round_trip"](spark, sf).collect()} == expected


def test_decode_joins_pieces(spark, lib):
    rows = [(i, lib.encode(t, add_special_tokens=False).ids) for i, t in enumerate(ODD)] + [(50, None), (51, [])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in B.decode(df, ["doc_id"]).collect()}
    assert got == {**dict(enumerate(ODD)), 50: "", 51: ""}


def test_driver_holds_no_tokenizer(spark, lib, monkeypatch):
    """The vocabulary's file is read by tasks; the driver gets the pieces only."""
    import tokenizers

    def held(*_):
        raise AssertionError("the driver made a tokenizer")

    monkeypatch.setattr(tokenizers, "Tokenizer", type("Tokenizer", (), {"from_file": held}))
    rows = spark.createDataFrame([(1, "Ein Text, zwei Texte.")], "doc_id long, text string")
    got = [(r.doc_id, r.ids, r.decoded) for r in B.encode(rows).collect()]
    assert got == [want(lib, 1, "Ein Text, zwei Texte.")]
    assert [r.text for r in B.decode(B.encode(rows).drop("decoded"), ["doc_id"]).collect()] == ["Ein Text, zwei Texte."]
