"""Connected components of an edge table, by alternating stars.

Each round links every node to the smallest neighbour seen so far, first for
the larger neighbours (large star), then for the smaller ones (small star).
Edges never grow in number and the rounds needed are about the logarithm of
the longest chain.  Each round is cut into a written table; the driver sees
two numbers a round, never nodes or edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(a, b)`` long pairs to ``(node, root)``: root is the smallest node reachable.

    Nodes without an edge to another node are absent.  Pairs with a null and
    loops are ignored; repeated and reversed pairs count once.
    """

    now, seen = scratch.cut_with_state(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after, was = scratch.cut_with_state(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "star")
        scratch.drop(now)
        now, was, seen = after, seen, was
        if seen == was:
            break
    star = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return star.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
