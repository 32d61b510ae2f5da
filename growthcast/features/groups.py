"""Measures of a group of papers (an author or a venue) at the source period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from growthcast.config import TimeAxis
from growthcast.features.series import at, running, upto
from growthcast.session import materialise


def paper_facts(papers: DataFrame, axis: TimeAxis) -> DataFrame:
    """Scalar facts per paper: cumulative counts now and a window ago, last two periods."""
    past = axis.source - axis.window
    out = ["pid", "p0"]
    for name, series in (("cites", "n"), ("keys", "k")):
        out += [upto(series, axis, axis.source).alias(name), upto(series, axis, past).alias(f"{name}_past"),
                at(series, axis, axis.source).alias(f"{name}_0"), at(series, axis, axis.source - 1).alias(f"{name}_1")]
    return papers.select(*out)


def h_index(counts: DataFrame, cells: Sequence[str], value: str, out: str) -> DataFrame:
    """Largest h such that h members have a count of at least h.

    Members are first folded into a histogram of counts. A group with C
    citations has at most sqrt(2C) distinct counts, so the ranked part stays
    small even for a group that owns a third of the input; h is the largest
    min(v, members with a count >= v).
    """
    hist = counts.where(F.col(value) > 0).groupBy(*cells, value).agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(*cells).orderBy(F.col(value).desc()).rowsBetween(W.unboundedPreceding, 0)
    return (hist.withColumn("_m", F.sum("_n").over(w))
            .groupBy(*cells).agg(F.max(F.least(F.col(value), F.col("_m"))).alias(out)))


def group_measures(members: DataFrame, facts: DataFrame, group: str, axis: TimeAxis) -> DataFrame:
    """members(pid, group) -> one row of measures per group."""
    past = axis.source - axis.window
    # the sums and the h-index both read these rows: join once, write once
    rows = materialise(members.select("pid", group).join(facts, "pid"), "members")
    sums = rows.groupBy(group).agg(
        *[F.sum(f"{n}{s}").alias(f"{n}{s}") for n in ("cites", "keys") for s in ("", "_past", "_0", "_1")],
        F.count(F.lit(1)).alias("papers"), F.count_if(F.col("p0") <= past).alias("papers_past"),
        F.min("p0").alias("first"), F.max("cites").alias("max_single"))
    both = rows.select(group, F.explode(F.array(
        F.struct(F.lit("h").alias("at"), F.col("cites").alias("v")),
        F.struct(F.lit("h_past").alias("at"), F.col("cites_past").alias("v")))).alias("e")).select(group, "e.*")
    h = h_index(both, [group, "at"], "v", "hi").groupBy(group).agg(
        *[F.max(F.when(F.col("at") == a, F.col("hi"))).alias(a) for a in ("h", "h_past")])
    age = (F.lit(axis.source) - F.col("first") + 1).cast("int")
    mean_past = F.coalesce(F.col("cites_past") / F.nullif(F.col("papers_past"), F.lit(0)), F.lit(0.0))
    mean = F.col("cites") / F.col("papers")
    return sums.join(h, group, "left").select(
        group,
        F.coalesce("h", F.lit(0)).alias("hindex"),
        (F.coalesce("h", F.lit(0)) - F.coalesce("h_past", F.lit(0))).alias("hindex_delta"),
        F.col("cites").alias("citations"), (F.col("cites") - F.col("cites_past")).alias("citations_delta"),
        F.col("keys").alias("key_citations"), (F.col("keys") - F.col("keys_past")).alias("key_citations_delta"),
        F.col("cites_0").alias("citations_delta_0"), F.col("cites_1").alias("citations_delta_1"),
        F.col("keys_0").alias("key_citations_delta_0"), F.col("keys_1").alias("key_citations_delta_1"),
        mean.alias("mean_citations"), (mean - mean_past).alias("mean_citations_delta"),
        (F.col("cites") / age).alias("mean_citations_per_year"),
        "papers", (F.col("papers") - F.col("papers_past")).alias("papers_delta"),
        age.alias("age"), F.col("max_single").alias("max_single_paper_citations"))


def h_index_series(members: DataFrame, papers: DataFrame, group: str, axis: TimeAxis) -> DataFrame:
    """Per group: ``hist`` of h from its first period to the source, and ``hindex_in_<h>``."""
    rows = materialise(members.select("pid", group).join(papers.select("pid", "p0", "n"), "pid"), "members")
    counts = (rows.select(group, F.posexplode(running("n")).alias("_p", "_v"))
              .select(group, (F.col("_p") + axis.start).alias("per"), "_v"))
    by_period = h_index(counts, [group, "per"], "_v", "h")
    # one entry per period of the fixed axis
    maps = by_period.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("per", "h"))).alias("_m"))
    first = rows.groupBy(group).agg(F.min("p0").alias("first"))
    value = lambda t: F.coalesce(F.try_element_at("_m", t), F.lit(0))
    return first.join(maps, group).select(
        group, F.transform(F.sequence("first", F.lit(axis.source)), value).alias("hist"),
        *[value(F.lit(axis.source + h)).alias(f"hindex_in_{h}") for h in range(1, axis.horizons + 1)])
