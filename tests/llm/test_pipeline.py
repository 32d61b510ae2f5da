"""The pipeline, stage by stage, against the brute-force versions of its operators."""

import hashlib

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from growthcast.llm import toxicity as T
from growthcast.llm.tokens import tokenizer_path
from test_jaccard import brute as jaccard
from test_mixing import brute as mixed
from test_substrings import brute as repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return sorted((tuple(r) for r in df.select(P.COLUMNS).collect()), key=str)


def check(spark, docs, sf):
    """Runs all stages; each one's result against Python over its own input."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    bad = {r.doc_id for r in T.toxicity(docs, labels).where("predicted = 1").collect()}
    before = rows_of(docs)

    out = P.materialise(P.drop_toxic(spark, docs, sf), "t1")
    assert rows_of(out) == [r for r in before if r[0] not in bad]
    before = rows_of(out)

    out = P.materialise(P.drop_near_duplicates(spark, out, sf), "t2")
    least = {}
    for i, _, c in jaccard([(r[0], r[1]) for r in before]):
        least[i] = min(least.get(i, c if c is not None else i), c if c is not None else i) if i is not None else None
    assert rows_of(out) == [r for r in before if r[0] is None or least[r[0]] == r[0]]
    before = rows_of(out)

    out = P.materialise(P.cut_repeats(spark, out, sf), "t3")
    cut = {i: (n, text) for i, _, n, text in repeats([(r[0], r[1]) for r in before], 20)}
    assert rows_of(out) == sorted(((r[0], cut[r[0]][1], r[2], r[3], len(cut[r[0]][1])) if cut[r[0]][0] else r for r in before), key=str)
    before = rows_of(out)

    out = P.materialise(P.mix_sources(spark, out, sf), "t4")
    times = {i if i >= 0 else None: taken // size if size else 0 for i, size, _, _, taken in mixed([(r[0], r[1], r[3]) for r in before])}
    assert rows_of(out) == sorted((r for r in before for _ in range(times[r[0]])), key=str)
    before = rows_of(out)

    lib = Tokenizer.from_file(tokenizer_path())
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in before:
        ids = lib.encode(r[1], add_special_tokens=False).ids
        want.append((r[0], len(ids), digest(",".join(map(str, ids))), digest(lib.decode(ids, skip_special_tokens=False))))
    assert sorted((tuple(r) for r in P.tokens(spark, out, sf).collect()), key=str) == sorted(want, key=str)
    return want


def test_stages_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(check(spark, docs, sf), key=str) == sorted((tuple(r) for r in P.run(spark, sf).collect()), key=str)


def test_stages_on_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60").select(P.COLUMNS)
    odd = [(1000, None, None, None, None), (1001, "", "en", "src1", 0), (None, "no id here", "en", "src2", 10), (1002, "ab " * 30_000, "en", None, 5),
           (1003, "one two", "xx", "other", 7), (1004, "one two", "xx", "other", 7)]
    check(spark, docs.union(spark.createDataFrame(odd, SCHEMA)).withColumn("score", F.lit("clash")).withColumn("predicted", F.lit(1)), sf)


def test_empty(spark, sf):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in P.STAGES:
        docs = P.materialise(stage(spark, docs, sf), "empty")
        assert docs.count() == 0


@pytest.mark.parametrize("k", range(4))
def test_columns(spark, sf, k):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 20").withColumn("extra", F.lit(1))
    assert P.STAGES[k][1](spark, docs, sf).dtypes == spark.createDataFrame([], SCHEMA).dtypes


def test_rows_of_one_id_and_of_none(spark, sf):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in ((1, a), (5, a), (5, b), (None, b))], SCHEMA)
    assert rows_of(P.drop_near_duplicates(spark, docs, sf)) == sorted(((i, t, "en", "s", len(t)) for i, t in ((1, a), (5, b), (None, b))), key=str)
    # several rows of no id: each is taken as often as the mix takes it
    rows = [(None, " ".join(f"w{i}_{j}" for j in range(i + 3)), "en", f"s{i % 3}", 1) for i in range(30)] + [(None, "same row here", "en", "s1", 1)] * 7
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    taken = P.mixing.mix(docs).agg(F.sum("taken")).first()[0]
    out = [len(r.text.split()) for r in P.mix_sources(spark, docs, sf).collect()]
    assert sum(out) == taken > 0
