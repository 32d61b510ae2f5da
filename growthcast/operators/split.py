"""Hold-out split with capped test and valid sets, and fold numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from growthcast.operators.ranking import values_at
from growthcast.session import materialise

HEX_DIGITS = 12
CANDIDATE_FACTOR = 8  # candidates per wanted row before the final sort


def _sort_key(key: str, seed: int):
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")).cast("binary"))


def holdout_sizes(n: int, cap: int = 10_000) -> tuple[int, int]:
    return min(n // 5, cap), min(n // 10, cap)


def holdout_rows(entities: DataFrame, seed: int = 12, cap: int = 10_000, key: str = "row_id") -> DataFrame:
    """The test and valid rows, at most ``2 * cap`` of them: (key, split).

    Rows are ordered by a hash of the key. When the input is much larger than
    the hold-out, a hash threshold first thins it to a few times the wanted
    size, so that no task merges a top list from every partition; the kept
    count is verified and the threshold doubled until it suffices.
    """
    keyed = entities.select(key).withColumn("_k", _sort_key(key, seed))
    n = entities.count()
    n_test, n_valid = holdout_sizes(n, cap)
    need = n_test + n_valid
    share = CANDIDATE_FACTOR * need / n if n else 1.0
    while share < 1.0:
        limit = f"{int(share * 16 ** HEX_DIGITS):0{HEX_DIGITS}x}"
        thinned = keyed.where(F.col("_k") < limit)
        if thinned.count() >= need:
            keyed = thinned
            break
        share *= 2
    top = keyed.orderBy("_k", key).limit(need)
    # at most 2 * cap rows are ranked here
    rank = F.row_number().over(W.orderBy("_k", key))
    return top.select(key, F.when(rank <= n_test, "test").otherwise("valid").alias("split"))


def holdout_split(entities: DataFrame, seed: int = 12, cap: int = 10_000, key: str = "row_id") -> DataFrame:
    """(key, split) for every entity; what is not held out trains."""
    return with_split(entities.select(key), seed, cap, key)


def with_split(wide: DataFrame, seed: int = 12, cap: int = 10_000, key: str = "row_id") -> DataFrame:
    """Plus ``split``. The hold-out list is written once, so that no fit or prediction looks for it again."""
    held = materialise(holdout_rows(wide, seed, cap, key), "holdout")
    # bounded by 2 * cap rows, whatever the input
    return wide.join(F.broadcast(held), key, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def contiguous_folds(df: DataFrame, k: int, key: str = "row_id") -> DataFrame:
    """``fold`` 0..k-1: contiguous unshuffled blocks of a whole-number key, the first n mod k one longer.

    Only the first keys of the folds are looked up, so the rows are neither
    sorted nor joined.
    """
    n = df.count()
    q, r = divmod(n, k)
    sizes = [q + (i < r) for i in range(k)]
    starts = [sum(sizes[:i]) for i in range(1, k) if sizes[i]]
    fold = F.lit(0)
    for first in values_at(df.select(key), key, starts):
        fold = fold + F.when(F.col(key) >= F.lit(first), 1).otherwise(0)
    return df.withColumn("fold", fold.cast("int"))


def sorted_members(split: DataFrame, name: str, key: str = "row_id") -> DataFrame:
    return split.where(F.col("split") == name).select(key).orderBy(key)
