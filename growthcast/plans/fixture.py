"""Citation-style data read from the TPC-H-like tables.

Papers are parts, citations are order lines, authors are suppliers, venues are
brands; time is the quarter, counted from 1995.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from growthcast.config import TimeAxis

QUARTERS = TimeAxis(start=0, source=15, target=25, window=2)

# Column types of the tables that are read. Declaring them saves
# a footer-reading job per scan.
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_returnflag string",
    "orders": "o_orderkey bigint, o_orderdate timestamp_ntz",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _period(ts: str) -> Column:
    return ((F.year(ts) - 1995) * 4 + F.quarter(ts) - 1).cast("int")


def citation_events(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = ("pid", "per", "key")) -> DataFrame:
    """One row per citation: cited paper, citing record, author, period, key flag."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("pid"), F.col("l_orderkey").alias("oid"), F.col("l_suppkey").alias("sid"),
        (F.col("l_returnflag") == "R").alias("key"))
    orders = (table(spark, sf_dir, "orders")
              .where(F.col("o_orderdate") < F.lit("2001-07-01").cast("timestamp_ntz"))
              .select(F.col("o_orderkey").alias("oid"), _period("o_orderdate").alias("per")))
    # never broadcast: the size of two well-packed columns is estimated far below that of their rows, which grow with the input
    return lines.join(orders.hint("shuffle_hash"), "oid").select(*columns)


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pid"), F.col("p_brand").alias("venue"),
        (F.col("p_type") == "ECONOMY").alias("is_survey"))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from growthcast.features.series import paper_series

    return paper_series(citation_events(spark, sf_dir), QUARTERS)


def authorship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from growthcast.features.series import first_period_links

    return first_period_links(citation_events(spark, sf_dir, ("pid", "sid", "per")), QUARTERS)


def paper_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasting table of papers: role columns, increments and y_1..y_H."""
    from growthcast.features.series import entity_table

    return entity_table(papers(spark, sf_dir), "pid", "n", QUARTERS)
