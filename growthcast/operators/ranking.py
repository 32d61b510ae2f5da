"""Top-n, argmax and global ranks without an unpartitioned window on rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from growthcast.session import materialise

BUCKET_ROWS = 50_000  # values that one task ranks, about
PARTS = 256           # parts that a value range is cut into by one pass of ``values_at``


def top_n(df: DataFrame, n: int, by: Column, cells: Sequence[str] = (), tie: str = "row_id") -> DataFrame:
    """First n rows of each cell by ``by`` (an ordering), ties to the lowest id.

    The rank filter lets Spark keep only n rows per input partition before
    the shuffle.
    """
    if not cells:
        return df.orderBy(by, tie).limit(n)
    w = W.partitionBy(*cells).orderBy(by, F.col(tie))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def largest(df, n, value, cells=(), tie="row_id"):
    return top_n(df, n, F.col(value).desc(), cells, tie)


def smallest(df, n, value, cells=(), tie="row_id"):
    return top_n(df, n, F.col(value).asc(), cells, tie)


def argmax_row(df: DataFrame, value: str, cells: Sequence[str], key: str = "row_id") -> DataFrame:
    return df.groupBy(*cells).agg(
        F.max_by(key, F.struct(F.col(value), -F.col(key))).alias(key), F.max(value).alias(value))


def _in_ranges(df: DataFrame, order: Sequence[Column], rows: int) -> DataFrame:
    """Plus ``_p``: rows dealt to ranges of about ``rows`` each, in order of ``order`` and of ``_p``; written once, so that the ranges stay."""
    parts = max(1, math.ceil(df.count() / rows))
    return materialise(df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()), "ranges")


def global_row_number(df: DataFrame, key: str | Sequence[str], out: str, total: str | None = None, rows: int = BUCKET_ROWS) -> DataFrame:
    """Dense 1-based position by a unique key: places in a range after the counts of the ranges before it."""
    keys = [key] if isinstance(key, str) else list(key)
    placed = _in_ranges(df, [F.col(k) for k in keys], rows)
    # one row for each range
    ordered = W.orderBy("_p")
    heads = placed.groupBy("_p").agg(F.count("*").alias("_n")).select(
        "_p", F.coalesce(F.sum("_n").over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_head"),
        F.sum("_n").over(ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_total"))
    inside = F.row_number().over(W.partitionBy("_p").orderBy(*keys))
    cols = [(F.col("_head") + inside).alias(out)] + ([F.col("_total").alias(total)] if total else [])
    return placed.join(F.broadcast(heads), "_p").select(*df.columns, *cols)


def percent_rank(df: DataFrame, value: str, out: str, rows: int = BUCKET_ROWS) -> DataFrame:
    """(rank - 1) / (n - 1) over all rows; NULL values rank first, as one value.

    Rows are dealt to ranges of (value, hash of the row), so that a value which
    very many rows have lies in several ranges. Where a range goes on with the
    last value before it, its rows rank where that value began, which the ranges'
    counts tell; no value is joined with anything.
    """
    v = F.struct(F.col(value).isNotNull(), F.col(value))
    placed = _in_ranges(df, [F.col(value).asc_nulls_first(), F.xxhash64(*df.columns)], rows).withColumn("_v", v)
    placed = placed.withColumn("_less", F.rank().over(W.partitionBy("_p").orderBy("_v")) - 1)
    # one row for each range from here to the join
    heads = placed.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_v").alias("_first"), F.max("_v").alias("_last"), F.max("_less").alias("_below"))
    ordered = W.orderBy("_p")
    heads = heads.select("*", F.coalesce(F.sum("_n").over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_head"),
                         F.sum("_n").over(ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_total"),
                         F.coalesce(F.lag("_last").over(ordered) == F.col("_first"), F.lit(False)).alias("_goes_on"))
    begins = F.when(~(F.col("_goes_on") & (F.col("_first") == F.col("_last"))), F.col("_head") + F.col("_below"))
    heads = heads.withColumn("_run", F.max(begins).over(ordered.rowsBetween(W.unboundedPreceding, W.currentRow)))
    heads = heads.select("_p", "_first", "_head", "_total", F.when(F.col("_goes_on"), F.lag("_run").over(ordered)).otherwise(F.col("_head")).alias("_start"))
    before = F.when(F.col("_v") == F.col("_first"), F.col("_start")).otherwise(F.col("_head") + F.col("_less"))
    rank = F.when(F.col("_total") > 1, before / (F.col("_total") - 1)).otherwise(F.lit(0.0))
    return placed.join(F.broadcast(heads), "_p").select(*df.columns, rank.alias(out))


def values_at(df: DataFrame, key: str, ranks: Sequence[int]) -> list[int]:
    """The whole numbers at 0-based ranks of a unique key, found by counting.

    Each pass cuts every bracket into ``PARTS`` equal parts and counts the rows
    in them, so nothing is sorted or joined: passes grow with the logarithm of
    the key's range (below 2^63), and the driver gets ``PARTS`` counts for each rank.
    """
    if not ranks:
        return []
    low, high = df.agg(F.min(key), F.max(key)).first()
    brackets = [(low, high, r) for r in ranks]  # first and last value, rank inside
    while any(a < b for a, b, _ in brackets):
        widths = [-(-(b - a + 1) // PARTS) for a, b, _ in brackets]
        spans = {(a, b): w for (a, b, _), w in zip(brackets, widths)}
        part = F.array(*[F.when(F.col(key).between(a, b), F.struct(F.lit(i).alias("i"), F.expr(f"({key} - {a}L) div {w}L").alias("p")))
                         for i, ((a, b), w) in enumerate(spans.items())])
        counted = (df.select(F.explode(F.filter(part, lambda x: x.isNotNull())).alias("x")).groupBy("x.i", "x.p").count().collect())
        counts: dict[int, dict[int, int]] = {}
        for row in counted:
            counts.setdefault(row["i"], {})[row["p"]] = row["count"]
        number, narrowed = {ab: i for i, ab in enumerate(spans)}, []
        for (a, b, r), w in zip(brackets, widths):
            for p, n in sorted(counts[number[a, b]].items()):
                if r < n:
                    narrowed.append((a + p * w, min(b, a + (p + 1) * w - 1), r))
                    break
                r -= n
        brackets = narrowed
    return [a for a, _, _ in brackets]


def exact_median(df: DataFrame, value: str, cells: Sequence[str], accuracy: int = 10_000) -> DataFrame:
    """Exact median of each cell; only rows near it are ever sorted.

    An approximate quantile sketch brackets the median with a known rank
    error; rows below the bracket are counted, rows inside it ranked.
    """
    eps = 2.0 / accuracy
    sketch = df.groupBy(*cells).agg(
        F.percentile_approx(value, [max(0.0, 0.5 - eps), min(1.0, 0.5 + eps)], accuracy).alias("_q"),
        F.count(value).alias("_n"))
    v = F.col(value)
    # one row per cell
    near = df.join(F.broadcast(sketch), list(cells))
    below = near.groupBy(*cells).agg(F.count_if(v < F.col("_q")[0]).alias("_low"))
    hist = (near.where(v.between(F.col("_q")[0], F.col("_q")[1]))
            .groupBy(*cells, "_n", value).agg(F.count(F.lit(1)).alias("_c"))
            .join(below, list(cells)))
    upto = F.col("_low") + F.sum("_c").over(
        W.partitionBy(*cells).orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    lo, hi = F.expr("(_n + 1) div 2"), F.expr("_n div 2 + 1")
    return (hist.withColumn("_upto", upto)
            .groupBy(*cells).agg(
                F.min(F.when(F.col("_upto") >= lo, v)).alias("_a"),
                F.min(F.when(F.col("_upto") >= hi, v)).alias("_b"))
            .select(*cells, ((F.col("_a") + F.col("_b")) / 2).alias("median")))
