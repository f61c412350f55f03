"""Connected components of a graph by alternating large-star and small-star steps.

Both steps are a grouped minimum and a join on the node, so a node that holds a large
part of all edges is met by partial aggregation and by Spark's split of skewed joins.
Nothing is collected; each round's edges are checkpointed in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetally.llm.common import shared_dir


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root: for each node of an edge (columns u, v of one type) the smallest node it reaches.

    Self-loops and repeated edges do no harm; nodes without edges are not in the result.
    """
    shared_dir(edges.sparkSession)
    now = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    before = _signature(now)
    while before[0]:
        # Large star: each larger neighbour goes to the smallest of the neighbourhood.
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: the smaller neighbours and the node itself go to the smallest.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = moved.where(F.col("u") != F.col("v")).distinct().checkpoint()
        after = _signature(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
