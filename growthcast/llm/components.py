"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from growthcast.session import materialise


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the least node of its own.

    Each round joins every node with the least of its neighbours, so a hub
    with very many edges is one partial minimum and one skewed join. Rounds
    grow with the logarithm of the nodes; each is written to the shared
    folder, which ends its lineage. They end when the edges are stars around
    their least nodes, which another round would leave as they are. Nulls and
    loops make no edge.
    """
    pairs = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
             .where((F.col(a) != F.col(b))).distinct())
    pairs = materialise(pairs, "edges")
    while _open(pairs):
        # large star: greater neighbours of u go to the least node around u
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: lesser neighbours of u, and u, go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", "m")).distinct())
        pairs = materialise(small, "edges")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        pairs.select("v", "v").distinct())


def _open(pairs: DataFrame) -> bool:
    """Whether some node has two lesser neighbours, or a lesser and a greater one: the edges are no stars yet."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("lesser"), F.lit(0).alias("greater")).union(
        pairs.select("v", F.lit(0), F.lit(1)))
    return not ends.groupBy("node").agg(F.sum("lesser").alias("lesser"), F.max("greater").alias("greater")).where("lesser + greater > 1 AND lesser > 0").isEmpty()
