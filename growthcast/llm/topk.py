"""Exact top-k search by columnar branch and bound.

Components become integers, floor(scale * x). Rows lie in blocks, vertically:
one array for each dimension. For a block of queries and a block of
candidates, scores are accumulated ``STEP`` dimensions at a time; after each
step a pair's score can grow by the product of the remaining lengths at most
(Cauchy-Schwarz), and candidates that can't reach a query's k-th best score any
more are compacted away. Every block of queries meets every block of
candidates, and each such task returns its k best; the best of these are the
answer. Arithmetic is exact: whole numbers in 64 bits, bounds rounded up. Vectors
with a component beyond ``LIMIT`` could leave 64 bits; they are scored in
unbounded integers, without pruning.

Candidate blocks are dealt by a hash of the id, so equal vectors spread out.
The rows of a candidate block are sent once for each block of queries, a
fiftieth of the rows at ``QUERIES`` a block; nothing is collected or broadcast.

Nulls and edge cases: rows whose vector or id is null, or whose vector holds
nulls, NaN or infinities, take no part; vectors meet only those of their own
length; an empty vector scores 0 with its like; with fewer than k candidates all
are returned; equal scores go to the smaller id; rows that repeat an id are
candidates of their own but ask once, with the least of their vectors; a query
is never its own candidate (by id);
scores beyond 64 bits are held at their ends;
an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

SCALE, K = 256, 5
#: Rows of a block of queries and of candidates, and dimensions between two prunings.
QUERIES, CANDIDATES, STEP = 512, 4_096, 8
#: Partitions at most; more tasks than that share them.
TASKS = 10_000
#: Components up to it never take a score out of 64 bits.
LIMIT = 1 << 20
MOST = (1 << 63) - 1


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(id, n, v, large): integer vectors of the rows that take part; ``large`` holds the components as they are where one is beyond the limit, and v is null."""
    x = F.col(vec_col)
    usable = x.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    beyond = F.exists(scaled, lambda c: (c > LIMIT) | (c < -LIMIT))
    return vectors.where(F.coalesce(usable, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.size(x).alias("n"), F.when(~beyond, scaled).cast("array<int>").alias("v"),
        F.when(beyond, x.cast("array<double>")).alias("large"))


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding",
          k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for every row that is a query."""
    rows = whole_vectors(vectors, id_col, vec_col, scale)
    asking = whole_vectors(vectors.where(is_query), id_col, vec_col, scale)
    least = F.min_by(F.struct("n", "v", "large"), F.coalesce(F.col("v").cast("array<double>"), F.transform("large", lambda c: c * scale)))
    queries = asking.groupBy("id").agg(least.alias("x")).select("id", "x.*")
    blocks = queries.groupBy("n").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("q_blocks"))
    sizes = rows.groupBy("n").agg(F.ceil(F.count("*") / CANDIDATES).cast("int").alias("c_blocks"))
    plan = blocks.join(sizes, "n")
    q_block = F.pmod(F.xxhash64("id"), F.col("q_blocks")).cast("int")
    c_block = F.pmod(F.xxhash64("id", F.lit(1)), F.col("c_blocks")).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    asked = queries.join(plan, "n").select("n", q_block.alias("q"), each("c_blocks").alias("c"), F.lit(True).alias("asks"), "id", "v", "large")
    given = rows.join(plan, "n").select("n", each("q_blocks").alias("q"), c_block.alias("c"), F.lit(False).alias("asks"), "id", "v", "large")
    # a number of partitions of their own, as small ones would be put together
    tasks = plan.agg(F.sum(F.col("q_blocks").cast("long") * F.col("c_blocks"))).first()[0] or 1
    found = (asked.unionByName(given).repartition(min(tasks, TASKS), "n", "q", "c").groupBy("n", "q", "c")
             .applyInPandas(_search(k, scale), "query_id long, vec_id long, score long"))
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def _search(k: int, scale: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        n, ids, asks = int(rows["n"].iloc[0]), rows["id"].to_numpy(), rows["asks"].to_numpy()
        small = rows["large"].isna().to_numpy()
        columns = np.zeros((n, len(rows)), np.int64)
        if n and small.any():
            columns[:, small] = np.stack(rows["v"][small].to_list()).astype(np.int64).T
        large = {i: _whole(rows["large"].iloc[i], scale) for i in np.flatnonzero(~small).tolist()}
        order = np.flatnonzero(~asks & small)
        order = order[np.argsort(ids[order], kind="stable")]
        given, of = ids[order], columns[:, order]
        others = [i for i in large if not asks[i]]
        rest, out = remaining(of), []
        for at in np.flatnonzero(asks).tolist():
            if at in large:
                exact = [(int(given[i]), _product(large[at], of[:, i].tolist())) for i in np.flatnonzero(given != ids[at]).tolist()]
            else:
                place, score = branch_and_bound(columns[:, at], of, rest, given != ids[at], k)
                exact = list(zip(given[place].tolist(), score.tolist()))
            query = large.get(at) or columns[:, at].tolist()
            exact += [(int(ids[i]), _product(query, large[i])) for i in others if ids[i] != ids[at]]
            out += [(ids[at], i, s) for i, s in sorted(exact, key=lambda r: (-r[1], r[0]))[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")
    return run


def _whole(x: np.ndarray, scale: int) -> list[int]:
    """floor(scale * c) of every component; a product beyond doubles is taken in integers."""
    return [math.floor(c * scale) if math.isfinite(c * scale) else int(c) * scale for c in np.asarray(x, np.float64).tolist()]


def _product(a: list[int], b: list[int]) -> int:
    return max(-MOST - 1, min(sum(x * y for x, y in zip(a, b)), MOST))


def remaining(columns: np.ndarray) -> np.ndarray:
    """Lengths of what is left of every vector before each step and, at the end, none."""
    squares = (columns.astype(np.float64) ** 2)[::-1].cumsum(0)[::-1]
    return np.sqrt(np.concatenate((squares, np.zeros((1, columns.shape[1])))))


def branch_and_bound(query: np.ndarray, columns: np.ndarray, rest: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best columns, equal scores in order of place."""
    alive = np.flatnonzero(allowed)
    own = remaining(query[:, None])[:, 0]
    score = np.zeros(len(alive), np.int64)
    for d in range(0, len(query), STEP):
        end = min(d + STEP, len(query))
        # dimension by dimension over those still alive
        for i in range(d, end):
            if query[i]:
                score += query[i] * (columns[i] if len(alive) == columns.shape[1] else columns[i, alive])
        if len(alive) <= k or end == len(query):
            continue
        room = rest[end, alive] * own[end] * (1 + 1e-12) + 1e-6
        low = np.partition(score - room, len(alive) - k)[len(alive) - k]
        keep = score + room >= low
        if keep.mean() < 0.8:
            alive, score = alive[keep], score[keep]
    best = np.lexsort((alive, -score))[:k]
    return alive[best], score[best]
