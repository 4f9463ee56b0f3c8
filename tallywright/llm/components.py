"""Connected components of a graph of any size: union-find by alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import cut, drop_cut

#: Rounds after which something must be wrong: each halves the longest path at least.
MOST_ROUNDS = 64


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for every node of ``edges``.

    Each round points every larger neighbour of a node to the smallest node near
    it (large star), then every smaller one (small star), until all edges point
    to the components' smallest nodes. No node's neighbours are ever gathered:
    the smallest comes from an aggregate with partial sums in each task, and the
    join back can split a node of many edges, as both of its sides are written
    tables. The result is a table that :func:`~tallywright.llm.common.cut` wrote. It ends when the edges are stars. Loops, repeated edges and rows
    with a null end are left out; no edges give no rows.
    """
    ends = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b")))
    pointing = cut(ends.distinct())
    for _ in range(MOST_ROUNDS):
        if _settled(pointing):
            break
        # Of every node with a larger neighbour, the smallest of itself and all its neighbours.
        near = cut(pointing.select(F.col("b").alias("node"), F.col("b").alias("least")).unionByName(pointing.select(F.col("a").alias("node"), F.col("b").alias("least"))).groupBy("node").agg(F.min("least").alias("least")))
        large = cut(pointing.join(near, pointing["b"] == near["node"]).select("a", F.col("least").alias("b")).distinct())
        drop_cut(pointing, near)
        near = cut(large.groupBy("a").agg(F.min("b").alias("least")).withColumnRenamed("a", "node"))
        moved = large.join(near, large["a"] == near["node"]).filter(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
        pointing = cut(moved.unionByName(near.select(F.col("node").alias("a"), F.col("least").alias("b"))).distinct())
        drop_cut(large, near)
    else:
        if not _settled(pointing):
            raise RuntimeError(f"components are not settled after {MOST_ROUNDS} rounds")
    roots = pointing.select(F.col("b").alias("node")).distinct()
    found = cut(pointing.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component"))))
    drop_cut(pointing)
    return found


def _settled(pointing: DataFrame) -> bool:
    """Whether every node points to one other at most, and none that is pointed to points on."""
    ends = pointing.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(pointing.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    seen = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return seen.filter((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0))).isEmpty()


def local_forest(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``count`` nodes is connected to by the edges ``a[i]``-``b[i]``."""
    least = np.arange(count)
    while len(a):
        low, high = np.minimum(least[a], least[b]), np.maximum(least[a], least[b])
        open_ = low != high
        if not open_.any():
            break
        a, b = low[open_], high[open_]
        np.minimum.at(least, b, a)
        while True:
            nearer = least[least]
            if (nearer == least).all():
                break
            least = nearer
    return least
