"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every document joins its source's queue in a shuffled order, up to ``passes``
times. An item's virtual finish time is the running number of tokens of its
source divided by the source's target. Items are taken in the order of these
times until the total budget is used up, so each source gets its target to
within about one document.

Running sums are made in two levels (buckets of a source, then the documents
of a bucket), about sqrt(n) rows each, so a source with a third of all
documents is spread over many tasks. The cut is found from sums over bands of
virtual time; only the band that holds the cut is ordered document by document.

Nulls and edge cases: a null or empty text has size 0 and is never taken; a
null source is a source of its own, last in order; a source of size 0 has
target 0; repeated rows are items of their own; an empty table gives no rows;
columns other than the named ones are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from growthcast.llm.common import WORD
from growthcast.session import materialise

#: Weights that sources take in turn.
WEIGHTS = (1, 2, 3)
#: Times that a document can be taken at most; a target is at most so many times its source's size.
PASSES = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, passes: int = PASSES, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) -> plus ``weight`` and ``target``.

    Targets share the sum of all sizes by weight; one that would exceed
    ``passes`` times its source's size stops there and the rest is shared
    again. Sources ordered by size per weight stop first, so the level at
    which the others stand follows from running sums in that order.
    """
    n = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (n % len(weights) + 1).cast("int")).cast("long")
    fill, everything = W.orderBy("_fill", F.col("source").asc_nulls_last()), W.partitionBy()
    earlier = fill.rowsBetween(W.unboundedPreceding, -1)
    levels = (sizes.withColumn("weight", weight).withColumn("_limit", F.col("source_size") * passes)
              .withColumn("_fill", F.col("_limit") / F.col("weight"))
              .withColumn("_rank", F.row_number().over(fill))
              .withColumn("_level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(earlier), F.lit(0)))
                          / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)))))
    # the first source whose limit is not below the level, and all after it, stand at that level
    open_at = F.when(F.col("_fill") >= F.col("_level"), F.struct("_rank", "_level"))
    return levels.withColumn("_open", F.min(open_at).over(everything)).select(
        "source", "source_size", "weight",
        F.when(F.col("_rank") >= F.col("_open._rank"), F.col("weight") * F.col("_open._level"))
        .otherwise(F.col("_limit").cast("double")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        passes: int = PASSES, weights: tuple[int, ...] = WEIGHTS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row, and the columns to ``carry``, which also order rows of one id."""
    sized = materialise(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"), *carry), "mix-sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    targets = source_targets(sources.select("source", "source_size"), passes, weights)
    plan = (targets.join(sources.select(F.col("source").alias("_s"), "_n"), F.col("source").eqNullSafe(F.col("_s")))
            .select("_s", "source_size", "target", F.ceil(F.sqrt("_n")).alias("_buckets")))
    # a bucket is a range of the key's first 32 bits, so buckets follow the order of the key
    part = F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") / 4294967296.0
    placed = (sized.withColumn("_key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
              .join(plan, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
              .withColumn("_b", F.floor(part * F.col("_buckets"))))
    sums = placed.groupBy("source", "_b").agg(F.sum("size").alias("_bsum"))
    earlier = W.partitionBy("source").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select(F.col("source").alias("_s"), F.col("_b").alias("_b2"),
                         F.coalesce(F.sum("_bsum").over(earlier), F.lit(0)).alias("_before"))
    within = W.partitionBy("source", "_b").orderBy("_key", F.col("doc_id").asc_nulls_last(), "size", *carry).rowsBetween(W.unboundedPreceding, 0)
    queued = (placed.withColumn("_in", F.sum("size").over(within))
              .join(before, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_b2"))))
    # an item of no size never enters; one of a source with tokens always has a target
    finish = [(F.col("_before") + F.col("_in") + F.col("source_size") * p) / F.col("target") for p in range(passes)]
    times = materialise(queued.select("doc_id", "source", "size", "source_size", "target", "_key", *carry,
                                      F.when(F.col("size") > 0, F.array(*finish)).alias("_times")), "mix-times")
    last = _last_taken(times)
    if last is None:
        return times.select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), *carry)
    t, key = last
    entered = F.filter("_times", lambda x: (x < t) | ((x == t) & (F.col("_key") <= key)))
    return times.select("doc_id", "source", "size", "source_size", "target",
                        (F.col("size") * F.coalesce(F.size(entered), F.lit(0))).cast("long").alias("taken"), *carry)


def _last_taken(times: DataFrame) -> tuple[float, str] | None:
    """(virtual time, key) of the last item within the budget, the sum of all sizes; None if there is none."""
    total = times.where(F.col("_times").isNotNull()).agg(F.sum("size").alias("budget"), F.count("*").alias("n")).first()
    if not total.n:
        return None
    bands = math.ceil(math.sqrt(total.n))
    items = times.select("size", "_key", F.explode("_times").alias("t")).withColumn("_band", F.floor(F.col("t") * bands))
    running = W.orderBy("_band").rowsBetween(W.unboundedPreceding, 0)
    # the first band that goes over the budget, or else the last one
    sums = items.groupBy("_band").agg(F.sum("size").alias("w")).withColumn("upto", F.sum("w").over(running))
    row = sums.agg(F.coalesce(F.min(F.when(F.col("upto") > total.budget, F.struct("_band", "w", "upto"))),
                              F.max(F.struct("_band", "w", "upto"))).alias("x")).first().x
    # items of one time and key are taken together or not at all
    inside = (items.where(F.col("_band") == row["_band"])
              .withColumn("upto", F.lit(row.upto - row.w) + F.sum("size").over(W.orderBy("t", "_key")))
              .where(F.col("upto") <= total.budget).agg(F.max(F.struct("t", "_key")).alias("x")).first().x)
    return (inside.t, inside["_key"]) if inside else (row["_band"] / bands, "")
