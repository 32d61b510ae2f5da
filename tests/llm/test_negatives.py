"""Hard negatives against brute force over Python integers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from growthcast.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def mine(df, **kw):
    out = N.hard_negatives(df, F.col("vec_id") % 50 == 0, F.col("label"), **kw)
    assert out.columns == COLUMNS
    return sorted(tuple(r) for r in out.collect())


def brute(rows, positives=5, negatives=3):
    hold = lambda x: max(-(1 << 63), min(x, (1 << 63) - 1))
    usable = [(i, tuple(int(np.floor(float(np.float32(c)) * 256)) for c in v), l) for i, v, l in rows
              if i is not None and l is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    asked = {}
    for i, v, l in usable:
        if i % 50 == 0:
            asked[i] = min(asked.get(i, (l, v)), (l, v))
    for a, (label, q) in asked.items():
        scored = [(-hold(sum(x * y for x, y in zip(q, v))), i, l) for i, v, l in usable if len(v) == len(q)]
        for p, pid, _ in sorted(s for s in scored if s[2] == label and s[1] != a)[:positives]:
            found = sorted(s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p)[:negatives]
            out += [(a, pid, r, i, -p, -n) for r, (n, i, _) in enumerate(found, 1)]
    return sorted(out)


def drawn(n, dim, seed, near=0):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dim))
    v[n - near:] = v[:near] + 0.3 * rng.standard_normal((near, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return [(i, [float(x) for x in row.astype(np.float32)], int(rng.integers(4))) for i, row in enumerate(v)]


@pytest.mark.parametrize("dim", [3, 64, 70])
def test_many_blocks(spark, monkeypatch, dim):
    monkeypatch.setattr(N, "ROWS", 100)
    monkeypatch.setattr(N, "ANCHORS", 4)
    rows = drawn(700, dim, dim, near=100)
    assert mine(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_nulls_ties_and_clashing_columns(spark):
    one = [1.0, 0.5, -0.25]
    rows = [(0, one, 1), (0, [0.0, 0.0, 1.0], 2), (50, one, 2), (1, one, 1), (2, one, 1), (2, one, 1), (3, [0.9, 0.5, 0.0], 2), (4, [0.9, 0.5, 0.0], 3), (100, [0.0] * 3, 1),
            (5, [1.0, 0.4, 0.0], 2), (None, one, 1), (6, None, 1), (7, [1.0, None, 2.0], 1), (8, [float("nan")] * 3, 1), (9, [float("inf")] * 3, 1), (10, one, None),
            (150, [], 1), (151, [], 2), (152, [], 1), (200, [1.0, 2.0], 1), (201, [1.0, 2.0], 1), (202, [0.5, 1.0], 2)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("x")).withColumn("copies", F.lit("y")).withColumn("asks", F.lit("z"))
    assert mine(df) == brute(rows)
    assert mine(df.where("false")) == []


def test_crowd_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(N, "ROWS", 50)
    rows = drawn(200, 8, 5) + [(50, [0.5] * 8, 1)] * 300 + [(i, [0.5] * 8, 1) for i in range(1000, 1200)]
    assert mine(spark.createDataFrame(rows, SCHEMA).repartition(4)) == brute(rows)


def test_large_components(spark):
    rows = drawn(120, 6, 7)
    rows += [(1000 + i, [float(np.float32(c)) for c in np.array(v) * s], l) for i, (_, v, l) in enumerate(rows[:60]) for s in (1e5, 1e12, 1e30)]
    rows += [(50 * (100 + i), [float(np.float32(c)) for c in np.array(v) * s], l) for i, (_, v, l) in enumerate(rows[:6]) for s in (1.0, 1e20)]
    assert mine(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_every_interval_holds_its_product():
    rng = np.random.default_rng(3)
    for n in (1, 7, 64, 130):
        v = np.floor(rng.standard_normal((400, n)) * 256)
        words, along, left = N.codes_of(v)
        block = {"words": words, "along": along, "left": left, "length": np.sqrt((v * v).sum(1))}
        q = np.floor(rng.standard_normal(n) * 256)
        exact, widths = v @ q, []
        bounds = N.intervals(N.Anchor(q), block, np.arange(400))
        for low, high in bounds:
            assert (low <= exact).all() and (exact <= high).all()
            widths.append((high - low).mean())
            bounds.send(np.arange(400))
        assert len(widths) == N.CODES and widths == sorted(widths, reverse=True)
