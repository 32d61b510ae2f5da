"""Near-duplicate vectors and top-k search against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from growthcast.llm import collisions as C, queries as Q, topk as T


def unit_pairs(v, label):
    u = v / np.sqrt((v * v).sum(1, keepdims=True))
    return (u @ u.T >= C.COSINE) & (label[:, None] == label[None]) & ~np.eye(len(v), dtype=bool)


@pytest.mark.parametrize("block", [C.BLOCK, 5])
def test_recall_and_precision(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 64))
    v = np.concatenate([base[rng.integers(0, 60, 400)] + rng.standard_normal((400, 64)) * rng.random((400, 1)) * .45, base, base[:10], base[:10]])
    label = rng.integers(0, 3, len(v))
    df = spark.createDataFrame([(int(i), [float(c) for c in x], int(y)) for i, (x, y) in enumerate(zip(v, label))], "vec_id long, embedding array<double>, label int")
    true, got = unit_pairs(v, label), {r.vec_id: r for r in C.near_duplicates(df.repartition(3)).collect()}
    links = true.sum(1)
    assert len(got) == len(v) and all(got[i].n_links <= links[i] for i in range(len(v)))
    assert sum(r.n_links for r in got.values()) >= .95 * links.sum()
    for i, r in got.items():
        assert r.component_id <= i and r.kept == (r.component_id == i) and (r.n_links > 0 or r.component_id == i)


def test_recall_on_the_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    true = unit_pairs(np.stack(rows.embedding).astype(float), rows.label.to_numpy()).sum()
    got = sum(r.n_links for r in Q.QUERIES["op5_embedding_near_dedup"](spark, sf).collect())
    assert .95 * true <= got <= true


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 1), (4, [0.0, 0.0], 0), (5, None, 0), (6, [], 0), (7, [1.0, None], 0), (8, [nan, 1.0], 0),
            (9, [inf, 1.0], 0), (10, [1.0, 0.0], None), (None, [1.0, 0.0], 0), (11, [1.0, 0.0, 0.0], 0), (12, [1e300, 0.0], 0), (12, [1e300, 0.0], 0), (13, [-1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("cls", F.lit("x")).withColumn("n", F.lit(1))
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in C.near_duplicates(df).collect()), key=str)
    linked = [(1, 4, 1, True), (2, 4, 1, False), (12, 4, 1, False), (12, 4, 1, False), (None, 4, 1, True)]
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11, 13)]
    assert got == sorted(linked + alone, key=str)
    assert C.near_duplicates(df.limit(0)).count() == 0


def test_calibration():
    for cosine in (.8, .93, .99):
        g, tables = C.tables_for(10_000, cosine)
        assert 1 - (1 - C.cell_chance(cosine) ** g) ** tables >= C.MEET
        p, c = math.erf(C.WINDOW / math.sqrt(2)), C.least_count(cosine)
        assert sum(math.comb(C.LINES, k) * p ** k * (1 - p) ** (C.LINES - k) for k in range(c, C.LINES + 1)) >= C.PASS


def best(rows, k=5):
    ok = [(i, [math.floor(256 * c) for c in v]) for i, v in rows
          if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % 50 == 0}):
        a = min(v for i, v in ok if i == q)
        scored = sorted((-sum(x * y for x, y in zip(a, v)), i) for i, v in ok if i != q and len(v) == len(a))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("blocks", [(512, 4096), (3, 20)])
def test_top_k(spark, monkeypatch, blocks):
    monkeypatch.setattr(T, "QUERIES", blocks[0])
    monkeypatch.setattr(T, "CANDIDATES", blocks[1])
    rng = np.random.default_rng(5)
    v = rng.standard_normal((400, 37)).round(2) * rng.choice([.1, 1, 3], (400, 1))
    v[60:90] = v[50]
    rows = [(i, x) for i, x in enumerate(v.tolist())] + [(100, v[3].tolist()), (500, None), (550, [1.0, None]), (600, [float("nan")] * 37), (650, []), (651, []),
                                                         (700, [1.0]), (701, [2.0]), (702, [-1.0]), (None, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("id", F.lit(1))
    got = sorted(tuple(r) for r in T.top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert got == best(rows)
    assert T.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((120, 5)).round(3)
    v[[3, 50, 70]] *= 1e6
    v[[4, 71]] *= 1e30
    rows = [(i, x) for i, x in enumerate(v.tolist())] + [(200, [5000.0] * 5), (201, [-1e308] * 5), (202, [1e308] * 5), (203, [1.5] * 5)]
    got = sorted(tuple(r) for r in T.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect())
    whole = {i: [math.floor(256 * c) if abs(c) < 1e300 else int(c) * 256 for c in x] for i, x in rows}
    want = []
    for q in (0, 50, 100, 200):
        scored = sorted((-max(-2 ** 63, min(sum(a * b for a, b in zip(whole[q], x)), 2 ** 63 - 1)), i) for i, x in whole.items() if i != q)
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:5])]
    assert got == want
