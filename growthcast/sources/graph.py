"""JSON-lines citation graph and paper metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

GRAPH = "id string, cites array<string>"
PAPERS = "id string, year int, venue string, `is-survey` boolean, authors array<string>, `citations-in-year` map<string,int>"


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(citing, cited); the same reader serves the key-citation graph."""
    return spark.read.json(path, schema=GRAPH).select(F.col("id").alias("citing"), F.explode("cites").alias("cited"))


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=PAPERS).withColumnRenamed("is-survey", "is_survey")


def paper_facts(papers: DataFrame) -> DataFrame:
    return papers.select("id", "year", "venue", "is_survey").distinct()


def paper_authors(papers: DataFrame) -> DataFrame:
    return papers.select("id", F.explode("authors").alias("author")).distinct()


def paper_year_counts(papers: DataFrame) -> DataFrame:
    return papers.select("id", F.explode("citations-in-year").alias("year", "citations")).select(
        "id", F.col("year").cast("int").alias("year"), "citations")


def edge_records(edges: DataFrame, chunk: int = 1000) -> DataFrame:
    """(citing, cited, place) -> records of at most ``chunk`` cites, several per id if need be."""
    return (edges.groupBy(F.col("citing").cast("string").alias("id"), F.floor(F.col("place") / chunk).alias("_c"))
            .agg(F.collect_list(F.col("cited").cast("string")).alias("cites")).drop("_c"))
