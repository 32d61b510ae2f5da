"""Small helpers shared by the operators: tables and words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A word is a run of characters other than the space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words of a text; bytes.split() separates at exactly the space and U+0009 to U+000D."""
    return text.encode("utf-8", "replace").split() if text else []
