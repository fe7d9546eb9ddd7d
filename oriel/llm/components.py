"""Connected components of link tables, and the same on small arrays within a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oriel.session import materialise, release


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links left-right: the smallest node of each node's component."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        np.minimum.at(root, before[left], low)
        np.minimum.at(root, before[right], low)
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further
        keep = root[left] != root[right]
        left, right = left[keep], right[keep]
    return root


def connected(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a long, b long); component: the smallest node reachable.

    Alternating large and small stars: each node hands the smallest neighbour it knows to the larger, then to
    the smaller ones, until all links are (node, smallest). Rounds grow with the logarithm of the number of
    nodes. Each half is an aggregation that combines on the map side and a join that adaptive execution can
    split, so a node with many links is no hot task. Each round is a table in the shared folder. Self-links
    and repeated links are fine; nodes without links don't appear.
    """
    edges = materialise(links.select("a", "b").where("a is not null and b is not null and a <> b").distinct(), "links")
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        down = large.distinct()
        small_low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(small_low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        before, edges = edges, materialise(small, "links")
        release(before)
        # stars are finished when every node has one parent and no parent has one
        children = edges.groupBy("a").agg(F.count("*").alias("n"))
        open_links = children.where("n > 1").select("a").limit(1).union(edges.select(F.col("b").alias("a")).join(children.select("a"), "a", "left_semi").limit(1))
        if open_links.isEmpty():
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
