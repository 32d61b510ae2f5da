"""Substring dedup against plain Python over all windows."""

import random

import pytest
from pyspark.sql import functions as F

from growthcast.llm import substrings as S

#: Rows of no id come after all others.
LAST = (1 << 63) - 1


def brute(rows, window):
    words = [(i if i is not None else LAST, i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for d, _, w in words:
        for s in range(len(w) - window + 1):
            k = tuple(w[s:s + window])
            first[k] = min(first.get(k, (d, s)), (d, s))
    out = []
    for d, i, w in words:
        gone = {j for s in range(len(w) - window + 1) if (d, s) > first[tuple(w[s:s + window])] for j in range(s, s + window)}
        out.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return sorted(out, key=str)


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pos", F.lit("x")).withColumn("doc", F.lit(1)).repartition(3)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in S.remove_repeats(df, **how).collect()), key=str)


def made(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passages = [rng.choices(vocabulary, k=rng.randrange(15, 60)) for _ in range(4)]
    rows = []
    for i in range(n):
        w = rng.choices(vocabulary, k=rng.randrange(0, 120))
        for p in rng.sample(passages, rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = p
        rows.append((i, rng.choice([" ", "\n", "\t\x0b "]).join(w)))
    return rows + [(100 + i, rows[i % 7][1]) for i in range(40)]


@pytest.mark.parametrize("hot", [5000, 3])
def test_against_brute_force(spark, hot):
    rows = made(3)
    assert run(spark, rows, hot=hot) == brute(rows, 20)


def test_edges(spark):
    again = "a b c d e " * 30
    rows = [(1, None), (2, ""), (3, "  \n "), (4, again), (5, again + "tail"), (None, again), (7, "short one"), (7, "short one"),
            (8, "x y z " * 20), (9, "x y z " * 20), (9, "x y z " * 20), (10, "same " * 40), (11, "long " + "q r s t u v " * 20_000)]
    assert run(spark, rows) == brute(rows, 20)
    assert run(spark, []) == []


def test_other_lengths(spark):
    rows = made(9, 25)
    assert run(spark, rows, window=9, seed=4) == brute(rows, 9)


def test_rows_of_no_id(spark):
    rng = random.Random(4)
    a, b, c = (" ".join(rng.choices([f"w{i}" for i in range(500)], k=40)) for _ in range(3))
    assert run(spark, [(1, a), (None, a), (None, b)]) == sorted([(1, 40, 0, a), (None, 40, 40, ""), (None, 40, 0, b)], key=str)
    # of equal rows one stays, whichever it is
    assert run(spark, [(None, c), (None, c), (None, c), (2, b)]) == sorted([(None, 40, 40, "")] * 2 + [(None, 40, 0, c), (2, 40, 0, b)], key=str)


def test_shuffle_files_of_the_steps_are_gone(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(40))) for i in range(6)], "doc_id long, text string")
        out = S.remove_repeats(df)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= 2  # texts and what is gone from them; what came before is written
        assert sorted((r.doc_id, r.n_removed) for r in out.collect()) == [(0, 0), *((i, 40) for i in range(1, 6))]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
