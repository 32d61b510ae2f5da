"""Per-paper count series: one aggregate from which most features follow.

The period axis is short and fixed, so a paper's whole history is a fixed
set of conditional counters. Counts per paper and period are combined map-side,
in narrow rows; a paper's counters are filled where its few rows are together.
Histories, deltas, responses and cut-off sums are then projections without
further shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from growthcast.config import TimeAxis


def paper_series(events: DataFrame, axis: TimeAxis, key: str = "pid") -> DataFrame:
    """events(key, per, key flag) -> (key, p0, n[], k[]): counts per period start..target."""
    def counters(count: str) -> Column:
        each = (f"coalesce(sum(CASE WHEN per = {t} THEN {count} ELSE 0 END), 0)" for t in range(axis.start, axis.target + 1))
        return F.expr(f"array({', '.join(each)})")

    # a series nobody reads is pruned, counters included. The wide rows are made behind the shuffle: before it,
    # a task would hold one for each key that it meets
    counts = events.groupBy(key, "per").agg(F.count(F.lit(1)).alias("_n"), F.count_if("key").alias("_k"))
    return (counts.repartition(key).groupBy(key)
            .agg(F.min("per").alias("p0"), counters("_n").alias("n"), counters("_k").alias("k"))
            .where(F.col("p0") <= axis.source))


def upto(series: str, axis: TimeAxis, period: int) -> Column:
    """Sum of a count series through a period, as plain additions."""
    return F.expr(" + ".join(f"{series}[{i}]" for i in range(period - axis.start + 1)))


def at(series: str, axis: TimeAxis, period: int) -> Column:
    return F.expr(f"{series}[{period - axis.start}]")


def increments_to_source(series: str, axis: TimeAxis, first: str = "p0") -> Column:
    """Counts from the first period through the source period."""
    return F.expr(f"slice({series}, {first} - {axis.start} + 1, {axis.source} - {first} + 1)")


def running(series: str) -> Column:
    """Running sums of an array expression."""
    return F.expr(f"transform({series}, (x, i) -> aggregate(slice({series}, 1, i + 1), 0L, (s, v) -> s + v))")


def history(series: str, axis: TimeAxis, first: str = "p0") -> Column:
    """Dense cumulative history from the first period through the source period."""
    return running(f"slice({series}, {first} - {axis.start} + 1, {axis.source} - {first} + 1)")


def responses(series: str, axis: TimeAxis, prefix: str) -> list[Column]:
    return [upto(series, axis, axis.source + h).alias(f"{prefix}{h}") for h in range(1, axis.horizons + 1)]


def entity_table(papers: DataFrame, key: str, series: str, axis: TimeAxis) -> DataFrame:
    age = (F.lit(axis.source) - F.col("p0") + 1).cast("int")
    base = F.col("base")
    # each horizon adds one period to the one before it
    named = papers.select(
        F.col(key).alias("row_id"), upto(series, axis, axis.source).cast("double").alias("base"), age.alias("age"), series,
        at(series, axis, axis.source).cast("double").alias("delta"),
        at(series, axis, axis.source - 1).cast("double").alias("delta_1"),
        increments_to_source(series, axis).alias("inc"))
    later = "base"
    ys = []
    for h in range(1, axis.horizons + 1):
        later += f" + {series}[{axis.source + h - axis.start}]"
        ys.append(F.expr(later).alias(f"y_{h}"))
    return named.select("row_id", "base", "delta", "delta_1", (base / F.col("age")).alias("average"), "age", "inc", *ys)


def first_period_links(events: DataFrame, axis: TimeAxis, paper: str = "pid", author: str = "sid") -> DataFrame:
    """Distinct (paper, author, p0) of the events in a paper's first period."""
    first_seen = events.groupBy(paper, author).agg(F.min("per").alias("p0"))
    paper_first = first_seen.groupBy(paper).agg(F.min("p0").alias("p0"))
    return first_seen.join(paper_first, [paper, "p0"]).where(F.col("p0") <= axis.source)
