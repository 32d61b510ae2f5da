import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from growthcast.features.coauthors import CoauthorNetwork, recent_coauthors
from growthcast.features.groups import h_index
from growthcast.functions import scalars as S
from growthcast.operators import diagnostics as DG, metrics as M, ranking as K, reshape as R
from growthcast.sources import stored as ST, text as TX
from growthcast.session import new_table_path


def test_series_functions(spark):
    df = spark.createDataFrame([(1, [1, 1, 2, 3, 4]), (2, [0, 0, 0]), (3, [0, 0, 5]), (4, [7])], "row_id int, h array<int>")
    lo, hi = S.history_span("h")
    got = {r.row_id: r for r in df.select("row_id", S.cumulative_to_increments("h").alias("inc"), lo.alias("lo"), hi.alias("hi"),
                                          S.shifted_running_sum("h").alias("c")).collect()}
    assert got[1].inc == [1, 0, 1, 1, 1]
    assert (got[2].lo, got[2].hi) == (1, 3) and (got[3].lo, got[3].hi) == (3, 3) and (got[4].lo, got[4].hi) == (1, 1)
    assert got[1].c == [10.0, 11.0, 12.0, 14.0, 17.0]
    long = R.series_long(df, "h")
    back = {r.row_id: r.series for r in R.series_array(long).collect()}
    assert back == {1: [1, 1, 2, 3, 4], 2: [0, 0, 0], 3: [0, 0, 5], 4: [7]}
    inc = R.increments_long(long).where("row_id = 1").orderBy("t").collect()
    assert [r.increment for r in inc] == [1, 0, 1, 1, 1]


def test_ties_go_to_the_lowest_id(spark):
    df = spark.createDataFrame([(3, 1.0), (1, 1.0), (2, 0.5)], "row_id int, v double").withColumn("g", F.lit("x"))
    assert [r.row_id for r in K.largest(df, 1, "v").collect()] == [1]
    assert [r.row_id for r in K.largest(df, 1, "v", ["g"]).collect()] == [1]
    assert [r.row_id for r in K.smallest(df, 1, "v", ["g"]).collect()] == [2]
    assert K.argmax_row(df, "v", ["g"]).first().row_id == 1


@pytest.mark.parametrize("rows", [100, 50_000])
def test_bucketed_ranks_match_plain_windows(spark, rows):
    rng = random.Random(5)
    # a third of the rows share one value
    vals = [0.25 if rng.random() < 0.34 else round(rng.gauss(0, 1), 3) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(vals)), "row_id bigint, v double")
    got = {r.row_id: r.pr for r in K.percent_rank(df, "v", "pr", rows).collect()}
    below = {v: sum(x < v for x in vals) for v in set(vals)}
    assert all(got[i] == below[v] / (len(vals) - 1) for i, v in enumerate(vals))
    pos = {r.row_id: r.i for r in K.global_row_number(df, "row_id", "i", rows=rows).collect()}
    assert pos == {i: i + 1 for i in range(3000)}
    odd = spark.createDataFrame([(1, None), (2, 1.0), (3, None), (4, 2.0), (5, 1.0)], "row_id bigint, v double")
    assert {r.row_id: r.pr for r in K.percent_rank(odd, "v", "pr", rows).collect()} == {1: 0, 3: 0, 2: .5, 5: .5, 4: 1}


def test_values_at_ranks(spark):
    rng = random.Random(3)
    keys = sorted(rng.sample(range(-10**12, 10**12), 2000) + [2**61, -2**61])
    df = spark.createDataFrame([(k,) for k in keys], "row_id bigint")
    ranks = [0, 1, 7, 1000, 2000, 2001]
    assert K.values_at(df, "row_id", ranks) == [keys[i] for i in ranks]


@pytest.mark.parametrize("accuracy", [10, 10_000])
def test_exact_median(spark, accuracy):
    rng = random.Random(1)
    rows = [("a", rng.random()) for _ in range(1001)] + [("b", rng.random()) for _ in range(1000)] + [("c", 1.0)] * 500 + [("d", 3.0), ("d", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r["median"] for r in K.exact_median(df, "v", ["g"], accuracy).collect()}
    for g in "abcd":
        assert got[g] == np.median([v for k, v in rows if k == g])


def test_h_index(spark):
    rng = random.Random(2)
    counts = {g: [rng.randint(0, 30) for _ in range(rng.randint(1, 80))] for g in range(40)}
    df = spark.createDataFrame([(g, c) for g, cs in counts.items() for c in cs], "g int, c int")
    got = {r.g: r.h for r in h_index(df, ["g"], "c", "h").collect()}
    for g, cs in counts.items():
        want = max([h for h in range(len(cs) + 1) if sum(c >= h for c in cs) >= h])
        assert got.get(g, 0) == want


def _network():
    rng = random.Random(4)
    links = set()
    for pid in range(60):
        for sid in rng.sample(range(40), rng.choice([1, 1, 2, 3])):
            links.add((pid, sid))
    for pid, members in ((100, range(0, 30)), (101, range(20, 38)), (102, range(0, 30))):
        links |= {(pid, s) for s in members}
    links.add((200, 99))  # an author without coauthors
    return sorted(links)


@pytest.mark.parametrize("crowd", [2, 10, 1000])
def test_coauthor_network(spark, crowd):
    links = _network()
    df = spark.createDataFrame([(p, s, p % 16) for p, s in links], "pid bigint, sid bigint, p0 int")
    by_paper = {}
    for p, s in links:
        by_paper.setdefault(p, set()).add(s)
    weight = {}
    for members in by_paper.values():
        for a in members:
            for b in members - {a}:
                weight[a, b] = weight.get((a, b), 0) + 1
    authors = sorted({s for _, s in links})
    degree = {a: sum(1 for x, _ in weight if x == a) for a in authors}
    net = CoauthorNetwork(df, crowd)
    assert net.crowded == (crowd < 1000)
    assert {r.sid: r.degree for r in net.degrees().collect()} == degree
    for heavy in (False, True):
        w = {k: (v if heavy else 1) for k, v in weight.items()}
        out = {a: sum(v for (x, _), v in w.items() if x == a) for a in authors}
        rank = {a: 1 / len(authors) for a in authors}
        for _ in range(6):
            loose = sum(rank[a] for a in authors if not out[a])
            rank = {a: 0.15 / len(authors) + 0.85 * (loose / len(authors) + sum(
                rank[b] * v / out[b] for (b, c), v in w.items() if c == a)) for a in authors}
        got = {r.sid: r["rank"] for r in net.pagerank(heavy, 6).collect()}
        assert got.keys() == rank.keys()
        assert max(abs(got[a] - rank[a]) for a in authors) < 1e-12
        assert abs(sum(got.values()) - 1) < 1e-9
    recent = {r.sid: r.coauthors for r in recent_coauthors(df, 6, crowd).collect()}
    for a in authors:
        assert recent[a] == len({b for p, m in by_paper.items() if p % 16 > 6 and a in m for b in m - {a}})


def test_density(spark):
    rng = random.Random(7)
    rows = [(i, 1, rng.gauss(0, 1)) for i in range(300)] + [(300, 2, 0.5)] + [(301, 3, 1.0), (302, 3, 1.0)]
    rows += [(400 + i, 4, 0.1 if i % 3 == 0 else rng.lognormvariate(0, 2)) for i in range(200)]
    got = {r.row_id: r for r in DG.density_by_group(spark.createDataFrame(rows, "row_id int, g int, v double"), "g", "v").collect()}
    assert len(got) == len(rows) and all(got[i].density is None for i in (300, 301, 302))
    for g in (1, 4):
        v = np.array([x for _, k, x in rows if k == g])
        ids = [i for i, k, _ in rows if k == g]
        h = len(v) ** -0.2 * v.std(ddof=1)
        want = np.exp(-0.5 * ((v[:, None] - v[None, :]) / h) ** 2).sum(1) / (len(v) * h * math.sqrt(2 * math.pi))
        assert np.allclose([got[i].density for i in ids], want, rtol=1e-10)
        assert np.allclose([got[i].scaled for i in ids], want / want.max(), rtol=1e-10)


@pytest.mark.parametrize("rows", [7, 60, 10_000])
def test_ranks_of_a_hot_value(spark, rows):
    """Half of all rows share one value, over many ranges; no ranges' borders are part of a row's expression."""
    values = [0.0] * 300 + [None] * 50 + [float(i % 40) for i in range(250)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "row_id int, v double")
    out = K.percent_rank(df, "v", "pr", rows)
    low = lambda v: (v is not None, v or 0.0)
    ranked = sorted(map(low, values))
    want = {i: ranked.index(low(v)) / 599 for i, v in enumerate(values)}
    got = {r.row_id: r.pr for r in out.collect()}
    assert got == pytest.approx(want) and len(got) == 600
    assert "filter(array(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert K.percent_rank(df.limit(0), "v", "pr", rows).count() == 0


def test_density_across_spans(spark, monkeypatch):
    """Cells far apart, in many spans, and one value that half of a group has."""
    monkeypatch.setattr(DG, "SPAN", 7)
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(0, 1, 150), rng.normal(300, 1, 20), [4000.0], np.full(180, 0.25)])
    df = spark.createDataFrame([(i, "g", float(x)) for i, x in enumerate(v)], "row_id int, g string, v double")
    got = {r.row_id: r.density for r in DG.density_by_group(df, "g", "v").collect()}
    h = len(v) ** -0.2 * v.std(ddof=1)
    want = np.exp(-0.5 * ((v[:, None] - v[None, :]) / h) ** 2).sum(1) / (len(v) * h * math.sqrt(2 * math.pi))
    assert np.allclose([got[i] for i in range(len(v))], want, rtol=1e-10)


def _scored(spark, n=200, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        base = rng.randint(5, 30)
        for h in (1, 2):
            y = base + rng.randint(0, 5 * h)
            rows += [("F", "test", i, h, float(base), float(y), float(base)), ("G", "test", i, h, float(base), float(y), y + rng.gauss(0, 1))]
    return rows, spark.createDataFrame(rows, "model string, split string, row_id int, horizon int, base double, y double, pred double")


def test_metrics_against_numpy(spark):
    rows, df = _scored(spark)
    got = {(r.model, r.horizon): r for r in M.mape_with_error(df).collect()}
    r2 = {(r.model, r.horizon): r for r in M.r_squared(df).collect()}
    trimmed = {(r.model, r.horizon): r.pa_rsq for r in M.pa_r_squared_trimmed(df, 5, 7).collect()}
    pooled = {(r.model, r.horizon): r.pa_rsq for r in M.r_squared_without_outliers(df).collect()}
    worst = {max((x for x in rows if x[0] == m and x[3] == h), key=lambda x: ((x[6] - x[5]) ** 2, -x[2]))[2] for m in "FG" for h in (1, 2)}
    for m in "FG":
        for h in (1, 2):
            part = [x for x in rows if x[0] == m and x[3] == h]
            base, y, p = (np.array([x[i] for x in part]) for i in (4, 5, 6))
            ape = abs((p - y) / y)
            assert np.isclose(got[m, h].mape, ape.mean()) and np.isclose(got[m, h].se, np.sqrt(ape.var() / len(ape)))
            assert np.isclose(r2[m, h].rsq, 1 - ((p - y) ** 2).mean() / y.var())
            assert np.isclose(r2[m, h].pa_rsq, 1 - ((p - y) ** 2).mean() / (y - base).var())
            err = (p - y) ** 2
            gain = (y - base - (y - base).mean()) ** 2 - err
            drop = set(np.argsort(-err, kind="stable")[:5]) | set(np.argsort(-gain, kind="stable")[:7])
            keep = [i for i in range(len(y)) if i not in drop]
            assert np.isclose(trimmed[m, h], 1 - err[keep].mean() / (y - base)[keep].var())
            keep = [i for i, x in enumerate(part) if x[2] not in worst]
            assert np.isclose(pooled[m, h], 1 - err[keep].mean() / (y - base)[keep].var())
    assert r2["F", 1].pa_rsq <= 0


def test_sources_round_trip(spark):
    path = new_table_path(spark, "lines")
    lines = [f"{i}\t{i * i}" for i in range(5000)]
    spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, value string").repartition(7).orderBy("i").select("value").write.text(path)
    for size in ("128m", "1k"):  # many splits per file in the second case
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        try:
            got = {r.row_id: r.value for r in TX.numbered_lines(spark, path).collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert got == dict(enumerate(lines))


def test_part_files_go_by_number(spark):
    path = new_table_path(spark, "parts")
    spark.createDataFrame([("b",)], "value string").coalesce(1).write.text(path)
    part, = Path(path.removeprefix("file:")).glob("part-*.txt")
    for n, text in (("99999", "x\ny\n"), ("100000", "z\n")):
        part.with_name(f"part-{n}-{part.name.split('-', 2)[2]}").write_text(text)
    got = {r.row_id: r.value for r in TX.numbered_lines(spark, path).collect()}
    assert got == dict(enumerate("bxyz"))


def test_read_or_build_builds_once(spark):
    path, calls = new_table_path(spark, "snap"), []

    def build():
        calls.append(1)
        return spark.range(3)

    assert ST.read_or_build(spark, path, build).count() == 3
    assert ST.read_or_build(spark, path, build).count() == 3
    assert len(calls) == 1
