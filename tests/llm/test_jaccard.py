"""Jaccard components against plain Python over all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from growthcast.llm import jaccard as J, trees


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    part = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * len(sets[a] | sets[b]):
                x, y = part[a], part[b]
                part = [y if p == x else p for p in part]
    least = {}
    for (i, _), p in zip(rows, part):
        least[p] = min(least.get(p, J.LAST), J.LAST if i is None else i)
    return sorted(((i, len(s), None if least[p] == J.LAST else least[p]) for (i, _), s, p in zip(rows, sets, part)), key=str)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cls", F.lit("x")).withColumn("doc", F.lit(1)).repartition(3)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(df).collect()), key=str)


def made(seed, docs=150):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(300)]
    bases = [rng.choices(vocabulary, k=rng.randrange(5, 200)) for _ in range(docs // 12)]
    passage = rng.choices(vocabulary, k=50)
    rows = []
    for i in range(docs):
        w = list(rng.choice(bases))
        for _ in range(rng.randrange(0, 1 + len(w) // 25)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < .3:
            w = rng.choices(vocabulary, k=rng.randrange(1, 90)) + passage
        rows.append((i * 3 % 1000, " ".join(w).lower() if rng.random() < .5 else "\n".join(w)))
    return rows


@pytest.mark.parametrize("block", [1000, 7])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK", block)
    rows = made(4)
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE\ttwo"), (6, "one two three"), (None, "one two"), (8, "É a b c d e"), (9, "é a b c d e"),
            (None, "alone here"), (11, "x " * 60_000), (12, "x " * 70_000), (13, " ".join(f"t{i}" for i in range(30_000))), (14, " ".join(f"t{i}" for i in range(29_000)))]
    rows += [(20, "same row twice of five words")] * 2
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_trees_lose_no_pair():
    rng = np.random.default_rng(2)
    base = [rng.integers(0, 2**63, size=k, dtype=np.uint64) for k in rng.integers(1, 300, 20)]
    sets = []
    for k in range(300):
        s, drop = base[k % 20].copy(), rng.random() * .3
        s = s[rng.random(len(s)) >= drop]
        if len(s):
            sets.append(np.unique(s))
    sizes = np.array([len(s) for s in sets])
    true = {(a, b) for a in range(len(sets)) for b in range(a) if J._linked(sets[a], sets[b], 80)}
    for bits in (1, 16):
        maps = [trees.bitmap(s, trees.width(len(s), bits)) for s in sets]
        got = [(max(p), min(p)) for x, y in trees.candidate_pairs(sizes, maps, 80) for p in zip(x.tolist(), y.tolist())]
        assert len(got) == len(set(got)) and true <= set(got)


def test_forest_connects_the_parts():
    rng = random.Random(6)
    for _ in range(100):
        part = np.array([rng.randrange(12) for _ in range(20)])
        pairs = [(x, y) for x in range(20) for y in range(x) if part[x] != part[y] and rng.random() < .1]
        x, y = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        weight = np.array([rng.randrange(5) for _ in pairs], float)
        taken = J._forest(part, x, y, weight).tolist()

        def joined(which):
            label = {p: p for p in part.tolist()}
            for k in which:
                a, b = label[part[x[k]]], label[part[y[k]]]
                label = {p: b if v == a else v for p, v in label.items()}
            return label

        every = joined(range(len(pairs)))
        mine = joined(taken)
        assert {(a, b) for a in mine for b in mine if mine[a] == mine[b]} == {(a, b) for a in every for b in every if every[a] == every[b]}
        assert len(taken) == len(every) - len(set(every.values()))


def test_pairs_of_a_large_group_stay_in_their_tasks(spark):
    rng = random.Random(7)
    base = rng.choices([f"w{i}" for i in range(400)], k=60)
    rows = []
    for i in range(300):
        w = list(base)
        for k in rng.sample(range(60), rng.randrange(3)):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    assert run(spark, rows) == brute(rows)


def test_levels_hold_little_in_the_driver(spark):
    """Buckets become levels a slice at a time, not all as doubles; the levels are those of all at once."""
    import tracemalloc

    rows = [("a b c d e f g",), ("a b c d e x",), (None,)]
    texts = spark.createDataFrame(rows, "text string")
    tracemalloc.start()
    got = J._levels(texts, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    hasher, counts = J.Hasher(), np.zeros(1 << J.BUCKET_BITS, np.int64)
    for (text,) in rows:
        np.add.at(counts, J._bucket(J._shingles(text, 1, hasher, distinct=False)), 1)
    assert np.array_equal(got, np.floor(2 * np.log2(np.maximum(counts / max(counts.mean(), 1.0), 1))).astype(np.uint8)) and got.max() > 0
    assert peak < 12 << 20


@pytest.mark.parametrize("edges, rounds", [([(2, 1), (3, 1), (5, 4), (7, 7), (None, 6)], 0), ([(1, 2), (2, 3)], 1), ([], 0)])
def test_components_end_with_stars(spark, monkeypatch, edges, rounds):
    """No round is run, planned and written only to see that it changes nothing."""
    from growthcast.llm import components as C

    written = []
    monkeypatch.setattr(C, "materialise", lambda df, label, write=C.materialise: written.append(label) or write(df, label))
    got = {(r.node, r.component) for r in C.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {0: set(), 5: {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}, 2: {(1, 1), (2, 1), (3, 1)}}[len(edges)]
    assert len(written) == 1 + rounds
