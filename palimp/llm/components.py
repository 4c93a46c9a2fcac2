"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimp.llm.base import staged


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component: for each node of the edges (a, b) the smallest node that it reaches.

    Large star: every neighbour that is larger than a node is tied to the smallest neighbour. Small star: a node and its
    smaller neighbours are tied to the smallest of them. Both keep components together, and after a number of rounds that
    grows with the logarithm of the largest distance every node hangs on the smallest one. Nodes with many edges are
    reduced by partial minima before the shuffle. Each round is written to the shared folder.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pairs, mark = staged(pairs, "edges"), None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        pairs = staged(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        n, total = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, total) == mark:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        mark = (n, total)
