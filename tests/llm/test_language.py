"""Language identification: against plain Python, and on rows that weren't learned from."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from growthcast.llm import language as L

SCHEMA = "doc_id long, text string, lang string"


def remainder(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 4


def plain_grams(text):
    """Buckets of all grams, one after another."""
    folded = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text or "")
    points = [0]
    for c in folded:
        p = 0 if c == " " else ord(c)
        if p or points[-1]:
            points.append(p)
    if points[-1]:
        points.append(0)
    mask, out = (1 << 64) - 1, []
    for i in range(len(points)):
        h = 0
        for n in range(L.ORDER):
            if i + n >= len(points):
                break
            h = (h + points[i + n] + n + 1) * 0x9E3779B97F4A7C15 & mask
            h ^= h >> 29
            out.append((h * 0x9E3779B97F4A7C15 & mask) >> (64 - L.BITS))
    return out


def brute(docs):
    counts, prior = defaultdict(Counter), Counter()
    for i, text, lang in docs:
        if remainder(i) != 2 and lang is not None:
            prior[lang] += 1
            counts[lang].update(plain_grams(text))
    out = []
    for i, text, _ in docs:
        if not prior or not any(c.isalpha() for c in text or ""):
            out.append((i, remainder(i) == 2, "und", 0.0))
            continue
        grams, logs = Counter(plain_grams(text)), {}
        for lang in sorted(prior):
            total = sum(counts[lang].values()) + L.SMOOTH * 2 ** L.BITS
            logs[lang] = math.log(prior[lang] / sum(prior.values())) + sum(n * math.log((counts[lang][g] + L.SMOOTH) / total) for g, n in grams.items())
        best = max(logs, key=logs.get)
        out.append((i, remainder(i) == 2, best, 1 / sum(math.exp(x - logs[best]) for x in logs.values())))
    return out


def same(got, want):
    key = lambda r: str(r[:3])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], abs=2e-3)


ODD = [(None, "the cat", "en"), (None, None, "en"), (1, "", "fr"), (2, "123 ... !!", "de"), (3, "Straße ÄÖ İ ǅ", "de"), (3, "le chat noir", "fr"), (4, "der Hund", None),
       (5, "漢字 かな", "ja"), (6, "the dog and the cat", "en"), (7, "x", ""), (8, "le chien " * 40_000, "fr"), (9, "\U0001d400 \U0001f600 é", "fr")]


def test_odd_texts(spark, monkeypatch):
    rows = ODD + [(100 + i, t, lang) for i, (_, t, lang) in enumerate(ODD)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("bucket", F.lit("x")).withColumn("score", F.lit("y"))
    want = brute(rows)
    out = L.identify(frame.repartition(3))
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    same([tuple(r) for r in out.collect()], want)
    for size in (5, 1_000):
        monkeypatch.setattr(L, "SLICE", size)
        model = L.Model(["a", "b"], np.log([.5, .5]), np.random.default_rng(1).random((1 << L.BITS, 2)).astype(np.float32), L.BITS)
        texts = [t for _, t, _ in ODD[:-2]]
        split = L.classify(pa.array(texts), model)[1]
        for i, t in enumerate(texts):
            total = model.weights[plain_grams(t)].astype(float).sum(0)
            p = np.exp(total - total.max())
            assert split[i] == pytest.approx((p / p.sum()).max() if any(c.isalpha() for c in t or "") else 0)


def test_nothing_to_learn(spark):
    rows = [(i, "the cat", None) for i in range(9)]
    assert {(r.lang_pred, r.score) for r in L.identify(spark.createDataFrame(rows, SCHEMA)).collect()} == {("und", 0.0)}
    assert L.identify(spark.createDataFrame([], SCHEMA)).collect() == []


def test_held_out_rows_of_the_table(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in L.identify(docs).collect() if r.held_out]
    assert len(held) > 150 and all(remainder(r.doc_id) == 2 for r in held)
    lettered = [r for r in held if r.lang_pred != "und"]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in lettered]) > 0.97
    assert all(0 <= r.score <= 1 for r in held)


def test_many_languages_shrink_the_matrix():
    assert [L.bits_for(n) for n in (0, 4, 60, 64, 200, 4_000, 60_000)] == [16, 16, 16, 15, 14, 9, 6]
    for n in (4, 200, 4_000, 60_000):
        assert n << L.bits_for(n) <= L.LANGUAGES << L.BITS
    with pytest.raises(ValueError):
        L.bits_for(70_000)
