"""The index against brute-force cosines; scores on held-out rows."""

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from growthcast.llm import queries as Q, toxicity as T
from growthcast.session import BATCH_BYTES, materialise


def made(seed=1, n=400, terms=30):
    rng = random.Random(seed)
    vectors = []
    for i in range(n):
        at = sorted(rng.sample(range(terms), rng.randrange(0, 6)))
        vectors.append((i * 3, int(any(a < 8 for a in at) and rng.random() < .9), at, [rng.randrange(1, 4) for _ in at]))
    return T.Model([f"t{i}" for i in range(terms)], np.linspace(1, 3, terms), vectors, .2), vectors


def test_nearest_is_exact():
    model, vectors = made()
    dense = np.zeros((len(vectors), len(model.number)))
    for k, v in enumerate(vectors):
        at, w = model.vector(dict(zip(v[2], v[3])))
        dense[k, at] = w
    rng = random.Random(4)
    for _ in range(300):
        counts = {i: rng.randrange(1, 3) for i in rng.sample(range(30), rng.randrange(0, 7))}
        at, w = model.vector(counts)
        cosine = dense[:, at] @ w if len(at) else np.zeros(len(dense))
        want = [k for k in np.lexsort((np.arange(len(dense)), -np.round(cosine, 12))) if cosine[k] > 0][:T.NEAREST]
        number, got = model.nearest(at, w)
        assert number.tolist() == want and np.allclose(got, cosine[want])


def test_held_out_fold(spark):
    ids = [0, 1, 7, 12345, -3, None]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", T.held_out(F.col("doc_id")).alias("h")).collect()
    assert [(r.doc_id, r.h) for r in got] == [(i, i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i in ids]


def test_scores_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = (Q.QUERIES["op4_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect())
    y, s = np.array([r.toxic for r in rows]), np.array([r.score for r in rows])
    above = (s[y == 1][:, None] > s[y == 0]).mean() + (s[y == 1][:, None] == s[y == 0]).mean() / 2
    assert above > .93 and ((s >= .5) == y).mean() > .94
    assert abs(s.mean() - y.mean()) < .03  # calibrated in the large


def test_labels_of_the_test_fold_are_not_used(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    rows = lambda x: sorted((r.doc_id, round(r.score, 9)) for r in T.toxicity(docs, x).collect())
    assert rows(labels) == rows(turned)


def test_edges(spark):
    bad = [(i, f"plain text here you scum number{i}", 1) for i in range(60)]
    good = [(100 + i, f"plain text here my friend number{i}", 0) for i in range(90)]
    odd = [(500, None, None), (501, "", None), (None, "you scum", 1), (502, "nothing known", None), (503, "scum " * 50_000, None), (504, "you scum", None), (504, "you scum", None)]
    df = spark.createDataFrame(bad + good + odd, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic", F.lit("clash").alias("text"))
    docs = df.drop("toxic").withColumn("label", F.lit(1)).withColumn("score", F.lit("x"))
    out = T.toxicity(docs, labels).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(bad + good + odd)
    assert got[504].predicted == 1 and got[503].predicted == 1 and got[None].predicted == 1
    assert {got[i].predicted for i in (500, 501, 502)} == {0} and 0 <= got[500].score < .5
    assert got[504].evidence[0].label == 1 and got[500].evidence == []
    none = T.toxicity(docs, labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)}
    assert T.toxicity(docs.limit(0), labels).count() == 0


def test_texts_without_toxic_terms_have_neighbours(spark):
    """Copies of examples that hold no term of the label come back as evidence with cosine 1."""
    rng = random.Random(5)
    words = [f"plain{i}" for i in range(300)]
    rows = [(i, " ".join(rng.sample(words, 12)) + (" scum" if i % 4 == 0 and i % 8 else ""), int(i % 4 == 0)) for i in range(400)]
    copies = [(1000 + i, text, None) for i, text, _ in rows]
    df = spark.createDataFrame(rows + copies, "doc_id long, text string, toxic int")
    got = {r.doc_id: r for r in T.toxicity(df.drop("toxic"), df.select("doc_id", "toxic")).collect()}
    used = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5]
    assert len(used) > 300
    for i in used:
        nearest = got[1000 + i].evidence[0]
        assert nearest.doc_id == i and nearest.label == int(i % 4 == 0) and abs(nearest.cosine - 1) < 1e-9


def test_texts_come_to_python_in_batches_of_few_bytes(spark, monkeypatch):
    sizes = []

    def spied(df, label, batch_bytes=None):
        if label == "toxicity-terms":
            sizes.append(batch_bytes)
        return materialise(df, label, batch_bytes)

    monkeypatch.setattr(T, "materialise", spied)
    docs = spark.createDataFrame([(i, ("bad " if i % 2 else "good ") * 50) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    assert T.toxicity(docs, labels).where("predicted = doc_id % 2").count() == 60
    assert sizes == [T.TEXT_BYTES]
    before = spark.conf.get(BATCH_BYTES)

    @F.arrow_udf("long")
    def together(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([len(b)] * len(b), pa.int64())

    rows = materialise(spark.range(0, 2_000, 1, 1).select(together(F.repeat(F.lit("0123456789"), 100)).alias("n")), "batches", 100_000)
    assert rows.count() == 2_000 and rows.agg(F.max("n")).first()[0] <= 200  # 2,000 without the bound
    assert spark.conf.get(BATCH_BYTES) == before


def test_numbers_of_words(monkeypatch):
    """Known words take no lookup of their own; unknown ones get their longest known beginning; texts do not mix."""
    terms = sorted({t for w in ("scum", "friendly", "friend", "plainest") for t in T.terms_of(w)})
    asked, missing = [], T.WordNumbers.__missing__
    monkeypatch.setattr(T.WordNumbers, "__missing__", lambda self, w: asked.append(w) or missing(self, w))
    numbers = T.WordNumbers(terms, most=2)
    texts = ["Scum friendly SCUM", None, "", "nothing", "friendship plainly frie", "x1 x2 x3 friendship scum", "scum"]

    def brute(text):
        found = {}
        for w in T.WORD.findall((text or "").lower()):
            known = [t for t in T.terms_of(w) if t in terms]
            for n in [terms.index(max(known, key=lambda t: (t == w, len(t))))] if known else []:
                found[n] = found.get(n, 0) + 1
        return sorted(found.items())

    got = numbers.packed(texts)
    assert [list(map(tuple, np.frombuffer(x, np.int32).reshape(2, -1).T.tolist())) for x in got] == [brute(t) for t in texts]
    assert not {"scum", "friendly"} & set(asked) and len(numbers) <= len(terms) + 2
    assert numbers.packed([]) == [] and T.WordNumbers([]).packed(["a b", None]) == [b"", b""]


def test_scores_are_written_in_small_batches_without_the_texts(spark, monkeypatch, tmp_path):
    import corpus_pipeline as P

    written = []

    def spied(df, label, batch_bytes=None):
        written.append((label, batch_bytes, df.columns))
        return materialise(df, label, batch_bytes)

    monkeypatch.setattr(T, "materialise", spied)
    rows = [(i, ("scum " if i % 2 else "good ") * 50 + f"w{i}", "en", "web", 9) for i in range(60)]
    rows += [(None, "scum scum w7", "en", "web", 9), (None, "good good w7", None, None, 9), (7, "good good w8", "en", "web", 9), (90, None, "en", "web", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = P.drop_toxic(spark, docs, str(tmp_path)).collect()
    tables = {label: (size, columns) for label, size, columns in written}
    assert tables["toxicity-scores"][0] == T.TEXT_BYTES and not any("text" in tables[t][1] for t in ("toxicity-terms", "toxicity-scores"))
    want = [r for r in rows if "scum" not in (r[1] or "")]
    assert sorted(map(str, map(tuple, left))) == sorted(map(str, want))
