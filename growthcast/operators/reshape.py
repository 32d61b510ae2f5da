"""Wide/long conversions, series conversions and key-based alignment."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F


def stack_horizons(wide: DataFrame, prefix: str = "y_", value: str = "y") -> DataFrame:
    """``<prefix>1..H`` columns -> one row per (row, horizon)."""
    ys = [c for c in wide.columns if c.startswith(prefix) and c[len(prefix):].isdigit()]
    ids = [c for c in wide.columns if c not in ys]
    long = wide.unpivot([F.col(c) for c in ids], [F.col(c).cast("double").alias(c) for c in ys], "_h", value)
    return long.withColumn("horizon", F.substring(F.col("_h"), len(prefix) + 1, 4).cast("int")).drop("_h")


def responses_long(wide: DataFrame, measure: str, key: str = "row_id") -> DataFrame:
    """``<measure>_in_<h>`` columns -> (key, horizon, y)."""
    return stack_horizons(wide, f"{measure}_in_")


def predictions_matrix(preds: DataFrame, horizons: int, keys: Sequence[str] = ("row_id",)) -> DataFrame:
    """Long predictions -> columns h1..hH."""
    cells = [F.max(F.when(F.col("horizon") == h, F.col("pred"))).alias(f"h{h}") for h in range(1, horizons + 1)]
    return preds.groupBy(*keys).agg(*cells)


def stack_models(frame: DataFrame, columns: dict[str, str], out: str = "pred") -> DataFrame:
    """One prediction column per model -> ``model``/``pred`` rows, in one pass."""
    used = list(columns.values())
    ids = [c for c in frame.columns if c not in used]
    return frame.unpivot(
        [F.col(c) for c in ids], [F.col(c).alias(m) for m, c in columns.items()], "model", out)


def union_predictions(frames: Sequence[DataFrame]) -> DataFrame:
    cols = ["model", "split", "row_id", "horizon", "pred"]
    return reduce(DataFrame.unionByName, [f.select(*cols) for f in frames])


def metric_by_year(table: DataFrame, horizons: int, first_year: int, value: str = "value",
                   keys: Sequence[str] = ("model",)) -> DataFrame:
    """Long metric rows -> one column per calendar year ``first_year + h - 1``."""
    cells = [F.max(F.when(F.col("horizon") == h, F.col(value))).alias(str(first_year + h - 1))
             for h in range(1, horizons + 1)]
    return table.groupBy(*keys).agg(*cells)


def replace_rows(table: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``table`` whose key occurs in ``fresh`` give way to those of ``fresh``."""
    kept = table.join(fresh.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(fresh.select(*table.columns))


def series_long(df: DataFrame, series: str, value: str = "value", key: str = "row_id") -> DataFrame:
    """Array column -> (key, t, value) with t from 1."""
    return df.select(key, F.posexplode(series).alias("_p", value)).select(
        key, (F.col("_p") + 1).alias("t"), value)


def series_array(long: DataFrame, value: str = "value", key: str = "row_id", out: str = "series") -> DataFrame:
    pairs = F.sort_array(F.collect_list(F.struct("t", value)))
    return long.groupBy(key).agg(F.transform(pairs, lambda p: p[value]).alias(out))


def increments_long(long: DataFrame, value: str = "value", key: str = "row_id") -> DataFrame:
    w = W.partitionBy(key).orderBy("t")
    return long.withColumn("increment", F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)))


def running_sum_before(long: DataFrame, value: str = "value", key: str = "row_id", prior: float = 10.0) -> DataFrame:
    """C_t = prior + sum of the values before t."""
    w = W.partitionBy(key).orderBy("t").rowsBetween(W.unboundedPreceding, -1)
    return long.withColumn("before", F.lit(prior) + F.coalesce(F.sum(value).over(w), F.lit(0)).cast("double"))


def align(*frames: DataFrame, key: str = "row_id") -> DataFrame:
    """1:1 inner join of frames that describe the same entities."""
    return reduce(lambda a, b: a.join(b, key), frames)


def restrict_to_split(df: DataFrame, split: DataFrame, name: str, key: str = "row_id") -> DataFrame:
    return df.join(split.where(F.col("split") == name).select(key), key, "left_semi")


def gather(df: DataFrame, rows: DataFrame, key: str = "row_id") -> DataFrame:
    return df.join(rows.select(key), key, "left_semi")


def remove_rows(df: DataFrame, rows: DataFrame, keys: Sequence[str] = ("row_id",)) -> DataFrame:
    return df.join(rows.select(*keys), list(keys), "left_anti")


def score_against(preds: DataFrame, truth: DataFrame, keys: Sequence[str] = ("row_id", "split", "horizon")) -> DataFrame:
    """Predictions matched with truth per row and horizon.

    The sides are merged, never broadcast: size estimates take a long frame that
    comes from arrays or from Python for as small as the wide rows it is made of.
    """
    return preds.join(truth.hint("merge"), list(keys))
