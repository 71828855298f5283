"""Connected components of an edge table, without a driver-side or single-task graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.sources.workspace import written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Edges (a, b) to one row (node, component) per node of an edge; component is the lowest
    node reachable. Self-edges and repeats are harmless, edges with a null end are left out.

    Stars are contracted in turns (large-star, small-star): every round each node's neighbours
    are hung on their lowest one, so that the number of rounds grows with the logarithm of the
    nodes. Each round is written to the shared folder, which cuts the lineage.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    pairs = written(pairs.distinct(), name)
    seen = None
    while (state := _state(pairs)) != seen:
        seen = state
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        lowest = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(root, "hi").select("lo", "m").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        pairs = written(small.union(root.select("hi", F.col("m").alias("lo"))).distinct(), name)
    nodes = pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return nodes.union(pairs.select("lo", "lo").distinct())


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(hi, lo))")).first())
