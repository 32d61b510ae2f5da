"""Near-duplicate vectors by counting collisions in random projections.

Vectors of one label are compared by cosine. For unit vectors at the threshold,
a projection on a Gaussian direction differs by a Gaussian whose spread is
their distance, so the chances of a collision are known and calibrate all
parameters:

* *Cells.* Each of ``L`` tables cuts ``g`` projections into cells of width ``CELL``;
  pairs meet that share a table's cell. g grows with the logarithm of the
  label's vectors, so a cell holds few strangers, and L is such that pairs at the
  threshold meet in some table with probability ``MEET``.
* *Windows.* In a cell, ``LINES`` further projections are sorted; a pair collides
  where one lies in the window of half-width ``WINDOW`` around the other. Pairs with
  so many collisions as those at the threshold reach with probability ``PASS`` are
  candidates.
* *Verification.* Candidates are joined to their vectors; the cosine is taken in
  double precision, so no link is below the threshold.

Equal vectors of a label are one class with a count. Cells of more than
``BLOCK`` classes are dealt into pairs of blocks, each a task of its own, so no
pair is lost and no task is unbounded.

Nulls and edge cases: a vector that is null, zero or empty, or holds nulls, NaN or
infinities, and one with a null label, links with nothing, is its own component
and is kept; vectors of unequal lengths don't link; rows that repeat an id are
vectors of their own; a component of null ids only is null, and its rows are
kept; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from growthcast.llm.components import connected
from growthcast.session import materialise

COSINE = 0.93
MEET, PASS = 0.985, 0.995
CELL, LINES, WINDOW, BLOCK, STRANGERS, SEED = 2.0, 32, 1.5, 1_000, 8, 7
#: Groups of so many rows are handled many at a time.
SMALL = 40
#: Steps of a projection's value that one unit is told apart by.
FINE = 32


def spread(cosine: float) -> float:
    """Distance of unit vectors: the standard deviation of their projections' difference."""
    return math.sqrt(2 - 2 * cosine)


def cell_chance(cosine: float) -> float:
    """Chance that one projection of a pair falls into one cell of width CELL."""
    s = spread(cosine)
    z = CELL / s
    return math.erf(z / math.sqrt(2)) - 2 * s / (CELL * math.sqrt(2 * math.pi)) * (1 - math.exp(-z * z / 2))


def tables_for(n: int, cosine: float) -> tuple[int, int]:
    """(g, L) for n vectors of one label."""
    # unit vectors without relation have cosine 0
    g = max(1, math.ceil(math.log(max(n, 2) / STRANGERS) / -math.log(cell_chance(0.0))))
    return g, math.ceil(math.log(1 - MEET) / math.log(1 - cell_chance(cosine) ** g))


def least_count(cosine: float) -> int:
    """Collisions that a pair at the threshold reaches with probability PASS."""
    p, tail, c = math.erf(WINDOW / math.sqrt(2)), 0.0, LINES + 1
    while tail < PASS:
        c -= 1
        tail += math.comb(LINES, c) * p ** c * (1 - p) ** (LINES - c)
    return c


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                    label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    x = F.col(vec_col)
    usable = (F.col(label_col).isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
              & F.exists(x, lambda c: c != 0))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), x.cast("array<double>").alias("v"),
                          F.coalesce(usable, F.lit(False)).alias("usable"))
    rows = rows.withColumn("cls", F.when(F.col("usable"), F.xxhash64("label", "v")))
    classes = materialise(rows.where("usable").groupBy("cls").agg(
        F.first("label").alias("label"), F.first("v").alias("v"), F.size(F.first("v")).alias("n"),
        F.min("vec_id").alias("least"), F.count("*").alias("copies")), "vectors")
    links = materialise(_links(classes, cosine), "links")
    both = links.union(links.select("b", "a"))
    found = (both.join(classes.select(F.col("cls").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
             .withColumnRenamed("a", "cls"))
    parts = connected(links).withColumnRenamed("node", "cls")
    named = (classes.select("cls", "least", "copies").join(found, "cls", "left").join(parts, "cls", "left")
             .withColumn("component", F.coalesce("component", "cls")))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = named.join(least, "component").select("cls", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = rows.select("vec_id", "usable", "cls").join(of_class, "cls", "left")
    component = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id").cast("long"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"),
                      F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def _links(classes: DataFrame, cosine: float) -> DataFrame:
    """(a, b): linked classes, each pair once."""
    largest = classes.groupBy("label", "n").count().agg(F.max("count").alias("n")).first().n or 0
    g, tables = tables_for(largest, cosine)
    cells = classes.select("cls", "label", "n", "v").mapInArrow(_cells(g, tables), "label string, n int, cell long, cls long, lines binary")
    blocks = cells.groupBy("label", "n", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("rows"))
    dealt = (cells.join(blocks.where("rows > 1").drop("rows"), ["label", "n", "cell"])
             .withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    tasks = dealt.select("label", "n", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "lines")
    group = ["cell", "label", "n", "i", "j"]
    pairs = (tasks.repartition(*group).sortWithinPartitions(*group)
             .mapInArrow(_count(least_count(cosine), WINDOW * spread(cosine)), "a long, b long").distinct())
    a, b = (classes.select(F.col("cls").alias(c), F.col("v").alias(f"v{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").where(_cosine("va", "vb") >= cosine).select("a", "b")


@F.pandas_udf(T.DoubleType())
def _cosine(x: pd.Series, y: pd.Series) -> pd.Series:
    """Cosine in double precision. Greatest components are taken out first, so that products neither overflow nor vanish."""
    out = np.empty(len(x))
    lengths = x.map(len).to_numpy()
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        a, b = (np.stack(v.iloc[at].to_list()).astype(float) for v in (x, y))
        a, b = (v / np.abs(v).max(1, keepdims=True) for v in (a, b))
        out[at] = (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))
    return pd.Series(out)


def _cells(g: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, tuple] = {}
        for batch in batches:
            n = batch.column("n").to_numpy()
            for size in np.unique(n).tolist():
                if size not in drawn:
                    rng = np.random.default_rng(SEED)
                    # whole numbers mix a table's cells into one
                    drawn[size] = (rng.standard_normal((size, g * tables + LINES)), rng.random(g * tables) * CELL,
                                   rng.integers(1, 1 << 62, (tables, g), dtype=np.int64) | 1)
                lines, shift, mix = drawn[size]
                at = np.flatnonzero(n == size)
                part = batch.take(pa.array(at))
                v = np.array(part.column("v").to_pylist(), np.float64)
                v /= np.abs(v).max(1, keepdims=True)
                v /= np.sqrt((v * v).sum(1, keepdims=True))
                p = v @ lines
                cell = np.floor((p[:, :g * tables] + shift) / CELL).astype(np.int64).reshape(-1, tables, g)
                # the table's number is part of its cells
                key = (cell * mix).sum(2) * np.int64(1_000_003) + np.arange(tables)
                fine = np.clip(np.round(p[:, g * tables:] * FINE), -32_000, 32_000).astype(np.int16)
                packed = pa.array([x.tobytes() for x in fine], pa.binary())
                label = part.column("label").cast(pa.string())
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([label, part.column("n"), pa.array(key[:, t]), part.column("cls"), packed],
                                                     ["label", "n", "cell", "cls", "lines"])
    return run


def collisions(left: np.ndarray, right: np.ndarray, window: int) -> np.ndarray:
    """Number of projections in which each right row lies in the window around each left row."""
    n, m = len(left), len(right)
    out = np.zeros(n * m, np.int64)
    for line in range(left.shape[1]):
        order = np.argsort(right[:, line], kind="stable")
        values = right[order, line].astype(np.int64)
        low = np.searchsorted(values, left[:, line].astype(np.int64) - window)
        high = np.searchsorted(values, left[:, line].astype(np.int64) + window, "right")
        wide = high - low
        at = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide) + np.repeat(low, wide)
        out[np.repeat(np.arange(n), wide) * m + order[at]] += 1
    return out.reshape(n, m)


def _count(least: int, window: float):
    """Pairs of each group (rows come sorted by it) with enough collisions."""
    wide = math.ceil(window * FINE) + 1  # rounding moves a difference by one step at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in chain(batches, [None]):
            if batch is not None:
                held = batch if held is None else pa.concat_batches([held, batch])
                if held.num_rows < 10 * BLOCK:
                    continue
            if held is None or not held.num_rows:
                continue
            start = _starts(held)
            # the last group may go on in the next batch
            upto = held.num_rows if batch is None else int(start[-1])
            if upto:
                yield _pairs(held.slice(0, upto), start[start < upto], least, wide)
                held = held.slice(upto)
    return run


def _starts(rows: pa.RecordBatch) -> np.ndarray:
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for c in ("cell", "n", "i", "j"):
        v = rows.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    label = rows.column("label")
    new[1:] |= pc.not_equal(label.slice(1), label.slice(0, len(label) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _pairs(rows: pa.RecordBatch, start: np.ndarray, least: int, wide: int) -> pa.RecordBatch:
    cls, own, i, j = (rows.column(c).to_numpy() for c in ("cls", "own", "i", "j"))
    lines = np.stack([np.frombuffer(x.as_buffer(), np.int16) for x in rows.column("lines")])
    length = np.diff(np.append(start, rows.num_rows))
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    # in small groups every pair is looked at, many groups at a time
    for n in range(2, SMALL + 1):
        first = start[length == n]
        p, q = np.triu_indices(n, 1)
        for k in range(0, len(first), max(1, 100_000 // len(p))):
            at = first[k:k + max(1, 100_000 // len(p)), None]
            x, y = (at + p).ravel(), (at + q).ravel()
            near = (np.abs(lines[x].astype(np.int32) - lines[y]) <= wide).sum(1) >= least
            found.append((x[near], y[near]))
    for s, n in zip(start[length > SMALL].tolist(), length[length > SMALL].tolist()):
        mine, theirs = (s + np.flatnonzero(own[s:s + n] == side[s]) for side in (i, j))
        for k in range(0, len(mine), 256):
            x, y = np.nonzero(collisions(lines[mine[k:k + 256]], lines[theirs], wide) >= least)
            found.append((mine[x + k], theirs[y]))
    x, y = (np.concatenate(z) for z in zip(*found))
    # within one block a pair is seen from both sides; across two, only rows of different blocks pair
    keep = (cls[x] != cls[y]) & ((i[x] == j[x]) | (own[x] != own[y]))
    a, b = np.minimum(cls[x], cls[y])[keep], np.maximum(cls[x], cls[y])[keep]
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
