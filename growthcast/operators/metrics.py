"""Error metrics over ``scored(model, split, row_id, horizon, base, y, pred)``.

Every table is one partial-then-final aggregate keyed by (model, split,
horizon), so a cell that holds most rows is still reduced map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from growthcast.functions.scalars import ape, squared_error
from growthcast.operators.ranking import argmax_row, largest, smallest, exact_median
from growthcast.operators.reshape import remove_rows

CELLS = ("model", "split", "horizon")


def mape(scored: DataFrame, cells: Sequence[str] = CELLS) -> DataFrame:
    return scored.groupBy(*cells).agg(F.avg(ape("pred", "y")).alias("mape"))


def mape_with_error(scored: DataFrame, cells: Sequence[str] = CELLS) -> DataFrame:
    """MAPE with its standard error sqrt(population variance / n)."""
    e = ape("pred", "y")
    return scored.groupBy(*cells).agg(
        F.avg(e).alias("mape"), F.sqrt(F.var_pop(e) / F.count(e)).alias("se"), F.count(e).alias("n_rows"))


def _explained(err, spread):
    """1 - err / spread with the IEEE values -inf and NaN where nothing spreads."""
    return (F.when(spread > 0, 1 - err / spread).when(err > 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan"))))


def r_squared(scored: DataFrame, cells: Sequence[str] = CELLS) -> DataFrame:
    """R2 against the spread of y, and past-adjusted R2 against that of y - base."""
    err = F.avg(squared_error("pred", "y"))
    return scored.groupBy(*cells).agg(
        _explained(err, F.var_pop("y")).alias("rsq"),
        _explained(err, F.var_pop(F.col("y") - F.col("base"))).alias("pa_rsq"))


def all_metrics(scored: DataFrame, cells: Sequence[str] = CELLS) -> DataFrame:
    """MAPE, its error, R2 and PA-R2 in long form from a single pass."""
    e, err = ape("pred", "y"), F.avg(squared_error("pred", "y"))
    wide = scored.groupBy(*cells).agg(
        F.avg(e).alias("mape"), F.sqrt(F.var_pop(e) / F.count(e)).alias("se"),
        _explained(err, F.var_pop("y")).alias("rsq"),
        _explained(err, F.var_pop(F.col("y") - F.col("base"))).alias("pa_rsq"))
    long = wide.unpivot([*cells, "se"], ["mape", "rsq", "pa_rsq"], "metric", "value")
    return long.select("metric", *cells, "value", F.when(F.col("metric") == "mape", F.col("se")).alias("se"))


def worst_rows(scored: DataFrame, cells: Sequence[str] = CELLS) -> DataFrame:
    """The row of largest squared error in each cell."""
    return argmax_row(scored.withColumn("err", squared_error("pred", "y")), "err", list(cells))


def pooled_outliers(scored: DataFrame) -> DataFrame:
    """Distinct (split, row) that are the worst row of some model and horizon."""
    return worst_rows(scored).select("split", "row_id").distinct()


def r_squared_without_outliers(scored: DataFrame) -> DataFrame:
    # one row per (model, split, horizon) at most, so the removed set is small
    out = F.broadcast(pooled_outliers(scored))
    return r_squared(remove_rows(scored, out, ("split", "row_id")))


def trimmed_rows(scored: DataFrame, n_worst: int, n_best: int) -> DataFrame:
    """Per cell: the n largest squared errors and the n largest gains over the base."""
    cells = list(CELLS)
    err = squared_error("pred", "y")
    growth = F.col("y") - F.col("base")
    means = scored.groupBy(*cells).agg(F.avg(growth).alias("_m"))
    # one row per (model, split, horizon)
    ranked = scored.join(F.broadcast(means), cells).select(
        *cells, "row_id", err.alias("_e"), ((growth - F.col("_m")) * (growth - F.col("_m")) - err).alias("_g"))
    worst = largest(ranked, n_worst, "_e", cells).select(*cells, "row_id")
    best = largest(ranked, n_best, "_g", cells).select(*cells, "row_id")
    return worst.union(best).distinct()


def pa_r_squared_trimmed(scored: DataFrame, n_worst: int = 50, n_best: int = 50) -> DataFrame:
    # at most n_worst + n_best rows per cell are removed
    gone = F.broadcast(trimmed_rows(scored, n_worst, n_best))
    kept = remove_rows(scored, gone, (*CELLS, "row_id"))
    return r_squared(kept).select(*CELLS, "pa_rsq")


def median_and_mean_ape(scored: DataFrame, cells: Sequence[str] = ("model", "split")) -> DataFrame:
    e = scored.select(*cells, ape("pred", "y").alias("ape"))
    mean = e.groupBy(*cells).agg(F.avg("ape").alias("mean_ape"))
    return exact_median(e, "ape", cells).withColumnRenamed("median", "median_ape").join(mean, list(cells))


def best_model(table: DataFrame, value: str, horizon: int, largest_wins: bool,
               candidates: Sequence[str] | None = None, on: str = "valid") -> DataFrame:
    """Best candidate by a metric at one horizon of one split; ties by list order."""
    rows = table.where((F.col("split") == on) & (F.col("horizon") == horizon))
    if candidates is not None:
        rows = rows.where(F.col("model").isin(list(candidates))).withColumn(
            "_ord", F.array_position(F.lit(list(candidates)), F.col("model")))
        pick = (largest if largest_wins else smallest)(rows, 1, value, tie="_ord")
        return pick.drop("_ord")
    return (largest if largest_wins else smallest)(rows, 1, value, tie="model")


def model_ranking(table: DataFrame, value: str, horizon: int) -> DataFrame:
    from pyspark.sql import Window as W

    # one row per model and split reaches this window
    w = W.partitionBy("split").orderBy(value, "model")
    return table.where(F.col("horizon") == horizon).withColumn("place", F.row_number().over(w))
