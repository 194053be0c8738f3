"""Connected components of a graph given as an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tastegrid.session import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, root)`` for every node of an edge; root is the smallest node reachable.

    Each round attaches every node to the smallest neighbour, first from the larger side and then from the smaller, until
    only stars are left. A round is two aggregates and two joins on the node; it is written to the shared folder, so a
    lost executor costs one round. Nulls and self loops are ignored; an empty table gives an empty one.
    """
    e = edges.where("a != b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct()
    e = materialise(e, "edges")
    while True:
        both = e.unionByName(e.select(F.col("m").alias("v"), F.col("v").alias("m")))
        low = both.groupBy("v").agg(F.min("m").alias("low")).withColumn("low", F.least("low", "v"))
        large = both.join(low, "v").where("m > v").select(F.col("m").alias("v"), F.col("low").alias("m"))
        large = large.distinct()
        low = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(low, "v")
        moved = small.where("m != low").select(F.col("m").alias("v"), F.col("low").alias("m"))
        n = materialise(moved.unionByName(low.select("v", F.col("low").alias("m"))).distinct(), "edges")
        roots = n.select(F.col("m").alias("v")).distinct().join(n.select("v").distinct(), "v", "left_semi")
        if roots.isEmpty():  # no node is both below and above another: only stars are left
            low = n.groupBy("v").agg(F.min("m").alias("root"))
            if n.count() == low.count():
                stars = low.select(F.col("v").alias("node"), "root")
                return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
        e = n
