"""Connected components by alternating large-star and small-star rounds over an edge table.

No neighbour list is ever gathered: each round needs a minimum by node, which is combined before the
shuffle, and a join, whose large partitions adaptive execution may split.

Up to SMALL different edges are connected by one task at once: every round costs the driver some statements, whose plans,
code and threads it keeps, however few the edges are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

#: Different edges that one task holds, 16 bytes each and some copies; any number gives the same result.
SMALL = 1_000_000


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).collect()[0]
    return r[0], r[1] or 0


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Edges come with a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def united(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges, sorted, and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _at_once(edges: DataFrame) -> DataFrame:
    def run(batches):
        t = pa.Table.from_batches(batches, pa.schema([("a", pa.int64()), ("b", pa.int64())]))
        nodes, roots = united(t["a"].to_numpy(), t["b"].to_numpy())
        yield from pa.table({"node": nodes, "root": roots}).to_batches(1 << 16)

    return edges.select("a", "b").repartition(1).mapInArrow(run, "node long, root long")


def connected_components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, root) of all nodes of edges (a, b); root is the component's smallest node, roots included.

    Edges may repeat, point either way or to themselves. An empty table gives an empty table.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    if state[0] <= small and {t for _, t in now.dtypes} == {"bigint"}:
        return cut(_at_once(now))
    while state[0]:
        before, now = now, cut(_small(_large(now).distinct()).distinct())
        drop(before)
        new = _state(now)
        if new == state:
            break
        state = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
