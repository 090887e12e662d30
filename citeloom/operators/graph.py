"""Connected components of edge tables, by contraction: nothing of the graph is gathered anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, tables) -> DataFrame:
    """Connected components of an edge table (a, b long): rows (node, component), the smallest node id.

    Alternating large-star and small-star contraction: each round hangs every neighbourhood on its
    smallest member, until all are stars (in a number of rounds that grows with the logarithm of the nodes); the edge
    table never grows. Each round is written by ``tables.write``, and ``tables.drop`` removes what no later one reads.
    Isolated nodes don't appear. Self loops and repeated edges are fine; no edges give no rows.
    """
    now = tables.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        after = tables.write(small)
        tables.drop(now)
        now = after
        # stars only: each node hangs on one other, which hangs on none
        ends = now.select(F.col("a").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
        ends = ends.unionByName(now.select(F.col("b").alias("x"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
        ends = ends.groupBy("x").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
        if ends.where("hangs > 1 or (hangs = 1 and holds = 1)").isEmpty():
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
