"""Connected components of a link table, and small union-find helpers for tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.plans.shared import stored


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """`node`, `component` (smallest node reachable) for every node of a link; self links and repeats are allowed.

    Alternates two steps until all links are stars: every larger neighbour of a node is linked to the node's
    smallest neighbour, then every smaller one is. The number of rounds grows with the logarithm of the longest path. Each round is written to the shared folder, which cuts the lineage. Rows of
    a node with many links are folded by a partial minimum before they move, and its join can be split.
    """
    edges = stored(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "links",
    )
    while _open(edges):
        large = _star(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), larger=True)
        edges = stored(_star(large, larger=False).distinct(), "links")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _open(edges: DataFrame) -> bool:
    """Whether a node has two links up, or one up and one down: then the links are not stars yet."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select(F.col("v").alias("node"), F.lit(0), F.lit(1))
    )
    counted = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return counted.where("up > 1 or (up = 1 and down = 1)").limit(1).count() > 0


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Link the neighbours of each node on one side to its smallest neighbour; links go from larger to smaller."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = edges.join(least, "u")
    if larger:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where(F.col("u") != F.col("v")).distinct()


class Forest:
    """Components of the positions 0 to n-1 of a task's own array, joined by arrays of pairs."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return up
            self.parent = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            root = self.roots()
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))
