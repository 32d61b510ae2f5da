"""Closed-form forecasters. ``fit`` returns a small parameter frame keyed by horizon.

A forecaster adds its prediction to a long frame ``(row_id, split, horizon,
base, delta, average, y)``. Parameters come from one aggregate over all
horizons at once and are joined back on ``horizon``.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from growthcast.functions.scalars import clamp_to_base


class Forecaster(Protocol):
    """What a user model provides to take part in a comparison."""

    name: str

    def fit(self, train: DataFrame) -> "Forecaster": ...

    def predict(self, frame: DataFrame, out: str) -> DataFrame: ...


class Constant:
    name = "F"

    def fit(self, train: DataFrame) -> "Constant":
        return self

    def predict(self, frame: DataFrame, out: str = "pred") -> DataFrame:
        return frame.withColumn(out, F.col("base"))


def _two_regressor_ols(frame: DataFrame, cells: list[str], x1: Column, x2: Column, y: Column) -> DataFrame:
    """Least squares with intercept per cell from (co)variances; minimum norm when singular."""
    m = frame.groupBy(*cells).agg(
        F.avg(x1).alias("m1"), F.avg(x2).alias("m2"), F.avg(y).alias("my"),
        F.var_pop(x1).alias("s11"), F.var_pop(x2).alias("s22"), F.covar_pop(x1, x2).alias("s12"),
        F.covar_pop(x1, y).alias("c1"), F.covar_pop(x2, y).alias("c2"))
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    full = det > F.lit(1e-12) * F.col("s11") * F.col("s22")
    tr = F.col("s11") + F.col("s22")
    # rank one: the pseudo-inverse of S is S / trace(S)^2
    b1 = (F.when(full, (F.col("s22") * F.col("c1") - F.col("s12") * F.col("c2")) / det)
          .when(tr > 0, (F.col("s11") * F.col("c1") + F.col("s12") * F.col("c2")) / (tr * tr))
          .otherwise(F.lit(0.0)))
    b2 = (F.when(full, (F.col("s11") * F.col("c2") - F.col("s12") * F.col("c1")) / det)
          .when(tr > 0, (F.col("s12") * F.col("c1") + F.col("s22") * F.col("c2")) / (tr * tr))
          .otherwise(F.lit(0.0)))
    return m.select(*cells, b1.alias("b1"), b2.alias("b2"), "m1", "m2", "my").select(
        *cells, (F.col("my") - F.col("b1") * F.col("m1") - F.col("b2") * F.col("m2")).alias("b0"), "b1", "b2")


@dataclass
class SimpleLinear:
    """Per horizon: y on (base, delta); all horizons in one aggregate."""

    name: str = "SM"
    params: DataFrame | None = None

    def save(self, path: str) -> None:
        self.params.write.parquet(path)

    def load(self, spark: SparkSession, path: str) -> "SimpleLinear":
        return SimpleLinear(self.name, spark.read.parquet(path))

    def fit(self, train: DataFrame) -> "SimpleLinear":
        params = _two_regressor_ols(train, ["horizon"], F.col("base"), F.col("delta"), F.col("y"))
        return SimpleLinear(self.name, params)

    def predict(self, frame: DataFrame, out: str = "pred") -> DataFrame:
        # one parameter row per horizon
        joined = frame.join(F.broadcast(self.params), "horizon")
        line = F.col("b0") + F.col("b1") * F.col("base") + F.col("b2") * F.col("delta")
        return joined.withColumn(out, clamp_to_base(line, "base")).drop("b0", "b1", "b2")


@dataclass
class VariableK:
    """One regression for all horizons: y on (base, horizon * average)."""

    name: str = "Variable k"
    params: DataFrame | None = None

    def save(self, path: str) -> None:
        self.params.write.parquet(path)

    def load(self, spark: SparkSession, path: str) -> "VariableK":
        return VariableK(self.name, spark.read.parquet(path))

    def fit(self, train: DataFrame) -> "VariableK":
        x2 = F.col("horizon") * F.col("average")
        one = _two_regressor_ols(train.withColumn("_all", F.lit(1)), ["_all"], F.col("base"), x2, F.col("y"))
        return VariableK(self.name, one)

    def predict(self, frame: DataFrame, out: str = "pred") -> DataFrame:
        joined = frame.withColumn("_all", F.lit(1)).join(F.broadcast(self.params), "_all")
        line = F.col("b0") + F.col("b1") * F.col("base") + F.col("b2") * F.col("horizon") * F.col("average")
        return joined.withColumn(out, clamp_to_base(line, "base")).drop("_all", "b0", "b1", "b2")


@dataclass
class PlusK:
    """pred = base + k * horizon, with k the Huber (epsilon 1) fit of the growth."""

    name: str = "PK"
    k: float | None = None

    def fit(self, train: DataFrame) -> "PlusK":
        return self if self.k is not None else PlusK(self.name, huber_slope(train))

    def predict(self, frame: DataFrame, out: str = "pred") -> DataFrame:
        return frame.withColumn(out, F.col("base") + F.lit(float(self.k)) * F.col("horizon"))


def huber_score(hist: DataFrame, ks: list[float]) -> list[float]:
    """g(k) = sum n h clip(d - k h, -1, 1) for several k in one aggregate."""
    def term(k: float) -> Column:
        r = F.col("d") - F.lit(k) * F.col("horizon")
        return F.sum(F.col("n") * F.col("horizon") * F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)))

    return list(hist.agg(*[term(k).alias(f"g{i}") for i, k in enumerate(ks)]).first())


def huber_slope(train: DataFrame, points: int = 24, rounds: int = 20) -> float:
    """Root of the decreasing score g, over the histogram of (horizon, growth).

    Every pass prices a grid inside the bracket together with the secant
    guess; g is piecewise linear, so the guess is exact once no kink lies
    inside the bracket.
    """
    hist = train.groupBy("horizon", (F.col("y") - F.col("base")).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    hist = hist.persist()
    try:
        lo, hi, weight = hist.agg(F.min((F.col("d") - 1) / F.col("horizon")), F.max((F.col("d") + 1) / F.col("horizon")),
                                  F.sum(F.col("n") * F.col("horizon"))).first()
        g_lo, g_hi = float(weight), -float(weight)  # every term is at its limit outside the kinks
        for _ in range(rounds):
            if hi - lo <= 1e-13 * max(1.0, abs(lo), abs(hi)):
                break
            guess = lo + (hi - lo) * g_lo / (g_lo - g_hi)
            ks = sorted([lo + (hi - lo) * (i + 1) / (points + 1) for i in range(points)] + [guess])
            gs = huber_score(hist, ks)
            near = min(range(len(ks)), key=lambda i: abs(gs[i]))
            if abs(gs[near]) <= 1e-12 * weight:
                return ks[near]
            cut = next((i for i, g in enumerate(gs) if g <= 0), len(ks))
            if cut < len(ks):
                hi, g_hi = ks[cut], gs[cut]
            if cut > 0:
                lo, g_lo = ks[cut - 1], gs[cut - 1]
        return lo + (hi - lo) * g_lo / (g_lo - g_hi)
    finally:
        hist.unpersist()


def predict_all(frame: DataFrame, fitted: list) -> DataFrame:
    """All models' predictions as rows: one projection per model, one unpivot."""
    from growthcast.operators.reshape import stack_models

    columns = {}
    for i, model in enumerate(fitted):
        columns[model.name] = f"_pred_{i}"
        frame = model.predict(frame, f"_pred_{i}")
    return stack_models(frame, columns)
