"""Plan shapes that matter at scale."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from growthcast.models.baselines import SimpleLinear
from growthcast.operators.ranking import largest
from growthcast.plans import fixture as fx, frames as fr
from growthcast.operators.split import holdout_rows


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_scans_are_pruned_and_filtered(spark, sf):
    text = plan(fx.paper_entities(spark, sf))
    assert "LessThan(o_orderdate" in text
    assert "l_extendedprice" not in text and "o_totalprice" not in text


def test_split_is_a_top_list(spark):
    assert "TakeOrderedAndProject" in plan(holdout_rows(spark.range(1000).withColumnRenamed("id", "row_id")))


def test_linear_fit_is_one_aggregate(spark, sf):
    text = plan(SimpleLinear().fit(fr.train_rows(fr.long_frame(spark, sf))).params)
    tree = text.split("\n\n")[0]
    assert tree.count("Exchange") <= 2 and "Union" not in tree and "SortMergeJoin" not in tree


def test_top_n_limits_before_the_shuffle(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 3).alias("g"), F.rand(1).alias("v"))
    assert plan(largest(df, 5, "v", ["g"])).count("WindowGroupLimit") >= 2


def test_no_cartesian_or_local_checkpoint():
    from pathlib import Path

    text = "".join(p.read_text() for p in (Path(__file__).resolve().parents[1] / "growthcast").rglob("*.py"))
    python_only = "\n".join(line for line in text.splitlines() if "CROSS JOIN" not in line)
    assert "localCheckpoint" not in python_only and "crossJoin" not in python_only


def test_feature_tables_are_complete(spark, sf):
    import __spark_entry__ as se

    assert len(se.queries()["d00_author_table"](spark, sf).columns) == 1 + 44
    assert len(se.queries()["d00_paper_table"](spark, sf).columns) == 1 + 63
