"""Range filters, guards and column or row selection."""

from __future__ import annotations

from functools import reduce
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from growthcast.config import Roles

INF = float("inf")


def parse_filters(text: str) -> tuple[dict[str, tuple[float, float]], str]:
    """``"f:min[,max];g:min"`` -> ({field: (min, max)}, canonical id)."""
    if text == "":
        return {}, ""
    clauses = sorted(text.split(";"))
    bounds: dict[str, tuple[float, float]] = {}
    for clause in clauses:
        field, sep, spec = clause.partition(":")
        values = [float(v) for v in spec.split(",")] if sep and ":" not in spec else []
        if len(values) not in (1, 2):
            raise ValueError(f"expected field:min[,max], got {clause!r}")
        bounds[field] = (values[0], values[1] if len(values) == 2 else INF)
    return bounds, "-".join(clauses)


def range_predicate(bounds: dict[str, tuple[float, float]]) -> Column:
    # the +inf bound stays: Spark orders NaN above every number, so only
    # the upper comparison keeps NaN out
    tests = [F.col(f).between(lo, hi) for f, (lo, hi) in bounds.items()]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def apply_filters(df: DataFrame, text: str) -> DataFrame:
    return df.where(range_predicate(parse_filters(text)[0]))


def columns_where(df: DataFrame, test: Callable[[str], bool], keep: Sequence[str] = ("row_id",)) -> DataFrame:
    return df.select(*keep, *[c for c in df.columns if c not in keep and test(c)])


def columns_of_measure(df: DataFrame, measure: str, keep: Sequence[str] = ("row_id",)) -> DataFrame:
    return columns_where(df, lambda c: measure in c.lower(), keep)


def role_columns(df: DataFrame, roles: Roles, key: str = "row_id") -> DataFrame:
    return df.select(
        key, *[F.col(c).cast("double").alias(a) for a, c in (
            ("base", roles.base), ("delta", roles.delta), ("average", roles.average), ("age", roles.age))])


def drop_zero_truth(df: DataFrame) -> DataFrame:
    return df.where(F.col("y") != 0)


def require_nonzero_truth(df: DataFrame) -> DataFrame:
    """Fail the query when any truth is 0 (a percentage error has no value there)."""
    return df.withColumn("y", F.when(F.col("y") == 0, F.raise_error(F.lit("zero truth"))).otherwise(F.col("y")))


def zero_truth_report(df: DataFrame, cells: Sequence[str] = ("split", "horizon")) -> DataFrame:
    return df.groupBy(*cells).agg(
        F.count_if(F.col("y") == 0).alias("zero_rows"), F.count(F.lit(1)).alias("n_rows"))


def integer_groups(df: DataFrame, group: str) -> DataFrame:
    """Rows whose group value is an integer of at least 1."""
    g = F.col(group)
    return df.where((g == F.floor(g)) & (g >= 1))


def models_in_order(spark_df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Rows of the named models with ``ord``, their place in the list."""
    names = list(names)
    return (spark_df.where(F.col("model").isin(names))
            .withColumn("ord", F.array_position(F.lit(names), F.col("model")).cast("int")))
