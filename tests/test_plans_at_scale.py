"""Plans whose size estimates know nothing of the rows that will come."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from growthcast.config import TimeAxis
from growthcast.features.series import paper_series
from growthcast.operators import reshape as R
from growthcast.plans import fixture, queries_models as Q


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_predictions_are_not_broadcast(spark):
    """Long predictions out of arrays are estimated as small as their wide rows."""
    wide = spark.range(200).select(F.col("id").alias("row_id"), F.lit("test").alias("split"), F.lit(5.0).alias("base"),
                                   *[F.lit(6.0 + h).alias(f"y_{h}") for h in range(1, 11)])
    each = wide.select("row_id", "split", F.posexplode(F.array([F.lit(7.0 + h) for h in range(1, 11)])).alias("_i", "pred"))
    preds = each.select(F.lit("M").alias("model"), "split", "row_id", (F.col("_i") + 1).alias("horizon"), "pred")
    for df in (Q.facts(wide, preds), R.score_against(preds, R.stack_horizons(wide))):
        assert "BroadcastHashJoin" not in plan_of(df)
    assert {(r.n_rows, r.none_below_base) for r in Q.facts(wide, preds).collect()} == {(200, True)}


def test_orders_are_not_broadcast(spark, sf):
    assert "Broadcast" not in plan_of(fixture.citation_events(spark, sf))


def test_series_are_narrow_before_the_shuffle(spark):
    """A task that meets many keys must not hold their wide counters: below each exchange there are a few aggregates at most."""
    axis = TimeAxis(start=0, source=15, target=25, window=2)
    rows = [(1, 3, True), (1, 3, False), (1, 25, True), (2, 16, True), (None, 2, None), (None, 2, True), (3, None, True), (3, 0, False)]
    events = spark.createDataFrame(rows, "pid long, per int, key boolean")
    out = paper_series(events, axis)
    lines = plan_of(out).splitlines()
    below = [lines[i + 1] for i, line in enumerate(lines) if "Exchange" in line]
    assert below and max(len(re.findall(r"partial_\w+\(", x)) for x in below) <= 3

    def series(**at):
        return [at.get(f"t{t}", 0) for t in range(26)]

    found = {r.pid: (r.p0, r.n, r.k) for r in out.collect()}
    assert found == {1: (3, series(t3=2, t25=1), series(t3=1, t25=1)), None: (2, series(t2=2), series(t2=1)), 3: (0, series(t0=1), series())}
