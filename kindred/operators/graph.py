"""Connected components of an edge table, by rounds that hang every node under smaller and smaller ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of edges (a, b): root is the smallest node that a path leads to.

    A round links each node's larger neighbours to the smallest of it and its neighbours, then its smaller
    neighbours to the smallest of them. Sums and joins only: no node's neighbours are ever gathered. Ends when
    nothing changes, after a number of rounds in the order of the logarithm of the nodes.
    """
    now = written(edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct())
    known = None
    while True:
        r = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("lo", "hi")).alias("x")).first()
        if (r.n, r.x) == known:
            break
        known = (r.n, r.x)
        both = now.select("lo", "hi").union(now.select("hi", "lo")).toDF("of", "other")
        down = both.join(both.groupBy("of").agg(F.min(F.least("of", "other")).alias("low")), "of")
        up = written(down.where("other > of").select(F.col("low").alias("lo"), F.col("other").alias("hi")).distinct())
        least = up.groupBy("hi").agg(F.min("lo").alias("low"))
        moved = up.join(least, "hi").where("lo <> low").select(F.col("low").alias("lo"), F.col("lo").alias("hi"))
        now = written(moved.union(least.select(F.col("low").alias("lo"), "hi")).distinct())
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
