"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from growthcast.models.baselines import SimpleLinear
from growthcast.operators.metrics import mape_with_error
from growthcast.plans import ctes, frames, queries_metrics, queries_features, queries_models, queries_relational  # noqa: F401
from growthcast.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = frames.long_frame(spark, sf_dir)
    fitted = SimpleLinear().fit(frames.train_rows(frame))
    scored = fitted.predict(frame.where(F.col("split") == "test"))
    return mape_with_error(scored, ["horizon"]).orderBy("horizon")
