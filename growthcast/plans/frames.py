"""Frames most queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from growthcast.models.baselines import Constant, SimpleLinear, VariableK, predict_all
from growthcast.operators.filters import range_predicate, parse_filters
from growthcast.operators.reshape import stack_horizons
from growthcast.operators.split import with_split
from growthcast.plans import fixture
from growthcast.session import materialise

MIN_CITATIONS = "base:5"


def entities(spark: SparkSession, sf_dir: str, filters: str = MIN_CITATIONS) -> DataFrame:
    """Filtered paper entities, written once: the split and every fit read this table."""
    wide = fixture.paper_entities(spark, sf_dir).where(range_predicate(parse_filters(filters)[0]))
    return materialise(wide, "entities")


def split_wide(spark: SparkSession, sf_dir: str, filters: str = MIN_CITATIONS) -> DataFrame:
    return with_split(entities(spark, sf_dir, filters))


def long_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack_horizons(split_wide(spark, sf_dir).drop("inc"))


def train_rows(frame: DataFrame) -> DataFrame:
    return frame.where(F.col("split") == "train")


def scored_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every split, horizon and closed-form model, with truth."""
    frame = long_frame(spark, sf_dir)
    train = train_rows(frame)
    models = [Constant(), SimpleLinear().fit(train), VariableK().fit(train)]
    return predict_all(frame, models).select(
        "model", "split", "row_id", "horizon", "base", "age", "y", "pred")


def linear_test_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last-horizon test rows of the linear model; at most 10,000, written once."""
    frame = long_frame(spark, sf_dir)
    sm = SimpleLinear().fit(train_rows(frame).where(F.col("horizon") == 10))
    last = frame.where((F.col("split") == "test") & (F.col("horizon") == 10))
    scored = sm.predict(last).withColumn("model", F.lit(sm.name))
    return materialise(scored.select("model", "split", "row_id", "horizon", "base", "age", "y", "pred"), "scored")
