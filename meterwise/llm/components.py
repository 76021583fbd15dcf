"""Connected components of a graph that is only ever a table of edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.llm.common import discard, staged


def _print(edges: DataFrame) -> tuple:
    """Number and checksum of the edges."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node that can be reached) for every node with an edge to another.

    ``edges`` has columns ``a`` and ``b``; direction, repetition and loops do not matter, edges with a null are ignored.
    Alternating star contraction: each round links the larger neighbours of every node to its smallest one, then
    the smaller ones. Rounds grow with the logarithm of the nodes. A node's neighbours are never gathered: minima are
    aggregated before the shuffle and joined back, and adaptive execution splits the join of a node with very many. Each
    round is a written table; the one before it is deleted.
    """
    start = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current = staged(start, "edges")
    known = _print(current)
    while known[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy(F.col("u").alias("k")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(lowest, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # A node's larger neighbours are gone; what is left of each are smaller ones.
        large = staged(large, "large-star")
        minimum = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        others = large.join(minimum, F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = staged(others.unionByName(minimum.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct(), "small-star")
        discard(large)
        found = _print(small)
        discard(current)
        current = small
        if found == known:
            break
        known = found
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


class Forest:
    """Union-find over numbers 0 to n - 1 for whole arrays of links; the label of a node is the smallest one it is linked to."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def link(self, a, b) -> None:
        while len(a):
            x, y = self.label[a], self.label[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(again := self.label[self.label], self.label):
                self.label = again
