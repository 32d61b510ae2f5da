"""Mixing against plain Python."""

import hashlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from growthcast.llm import mixing as M


def targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    left, out, open_ = Fraction(sum(sizes.values())), {}, set(sizes)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = Fraction(3 * sizes[s])
        left, open_ = left - sum(out[s] for s in over), open_ - over
    return out


def brute(rows):
    size = [len((t or "").encode().split()) for _, t, _ in rows]
    per = Counter()
    for (_, _, s), n in zip(rows, size):
        per[s] += n
    want, run, items = targets(per), Counter(), []
    key = [hashlib.md5(("" if d is None else str(d)).encode()).hexdigest() for d, _, _ in rows]
    for i in sorted(range(len(rows)), key=lambda i: (key[i], rows[i][0] is None, rows[i][0] or 0, size[i])):
        s = rows[i][2]
        run[s] += size[i]
        if size[i]:
            items += [((run[s] + p * per[s]) / float(want[s]), key[i], i) for p in range(3)]
    taken, total, groups = Counter(), 0, defaultdict(list)
    for t, k, i in items:
        groups[t, k].append(i)
    for at in sorted(groups):
        total += sum(size[i] for i in groups[at])
        if total > sum(size):
            break
        for i in groups[at]:
            taken[i] += size[i]
    return sorted((rows[i][0] if rows[i][0] is not None else -1, size[i], per[rows[i][2]], round(float(want[rows[i][2]]), 6), taken[i]) for i in range(len(rows)))


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("_key", F.lit(0))
    return sorted((r.doc_id if r.doc_id is not None else -1, r["size"], r.source_size, round(r.target, 6), r.taken) for r in M.mix(df).collect())


ROWS = [(i, "w " * (1 + i * 7 % 40), ["a", "b", "c", "é", None][min(i % 9, 4)]) for i in range(300)]


@pytest.mark.parametrize("rows", [
    ROWS,
    [(1, "one two", "tiny"), (2, "x " * 500, "big"), (3, "y " * 90, "mid"), (4, None, "none"), (5, "", "big"), (None, "z z", "big")],
    [(7, "a b c", "s")] * 4 + [(8, "a b c", "t")],
    [(1, None, None), (2, "", "x")],
    [(1, "long " * 30_000, "x"), (2, "s", "x"), (3, "s s", "y")],
])
def test_against_python(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_near_targets_and_bounds(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = M.mix(docs).collect()
    got, target, most = Counter(), {}, Counter()
    for r in rows:
        got[r.source] += r.taken
        target[r.source] = r.target
        most[r.source] = max(most[r.source], r["size"])
        assert r.taken <= 3 * r["size"]
    assert all(abs(got[s] - target[s]) <= 2 * max(most.values()) for s in target)


def test_no_python_in_the_plan(spark, sf):
    plan = M.mix(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
