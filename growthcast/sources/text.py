"""Delimited text, ragged histories and positional row keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T


def read_table(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Tab-separated file with a header; the schema is declared, never inferred."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema, enforceSchema=True)


def write_table(df: DataFrame, path: str, compression: str = "none") -> None:
    df.write.csv(path, sep="\t", header=True, compression=compression)


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def fields(line: str | Column = "value") -> Column:
    return F.split(line, "\t")


def ints(line: str | Column = "value") -> Column:
    return F.transform(fields(line), lambda x: x.cast("int"))


def matrix_columns(columns: Sequence[str], line: str | Column = "value") -> list[Column]:
    """Columns of a headerless numeric row."""
    parts = fields(line)
    return [F.get(parts, F.lit(i)).cast("double").alias(c) for i, c in enumerate(columns)]


def numbered_lines(spark: SparkSession, path: str, out: str = "row_id") -> DataFrame:
    """Lines with their 0-based position over the files in order of their numbers.

    A file split is read by one task from top to bottom, so a line's place in
    its split is the distance of its increasing id from the split's first. One
    light pass counts lines per split; running sums over the splits of a file
    and over the files (one row each) turn places into positions. Part files
    are ordered by their number, as names stop being padded at 100,000.
    """
    tagged = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_id"))
    splits = tagged.groupBy("_f", "_b").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    number = F.regexp_extract("_f", r"part-(\d+)", 1).cast("bigint")
    files = splits.groupBy("_f").agg(F.sum("_n").alias("_n")).select(
        F.col("_f"), earlier(W.orderBy(number.asc_nulls_first(), "_f")).alias("_head"))
    heads = (splits.withColumn("_inside", earlier(W.partitionBy("_f").orderBy("_b"))).join(files, "_f")
             .select("_f", "_b", "_first", (F.col("_head") + F.col("_inside")).alias("_offset")))
    return tagged.join(heads, ["_f", "_b"]).select(
        (F.col("_offset") + F.col("_id") - F.col("_first")).alias(out), "value")


def read_histories(spark: SparkSession, path: str) -> DataFrame:
    """Ragged integer rows -> (row_id, hist)."""
    return numbered_lines(spark, path).select("row_id", ints("value").alias("hist"))


def read_matrix(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Headerless numeric rows -> (row_id, columns)."""
    return numbered_lines(spark, path).select("row_id", *matrix_columns(columns))


def read_names(spark: SparkSession, path: str, out: str = "id") -> DataFrame:
    return numbered_lines(spark, path).withColumnRenamed("value", out)


def write_lines(df: DataFrame, path: str, compression: str = "none") -> None:
    """A one-column frame as text; the part files keep the frame's order."""
    df.write.text(path, compression=compression)
