"""Connected components of a graph of edges, as Spark jobs; nothing of the graph comes to the driver but two numbers a round."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b: long) that isn't its component's smallest; root is the smallest.

    Large stars and small stars in turn: each node's neighbours are linked to the smallest of them, until nothing changes.
    Minima are summed up before the shuffle, and a node with very many edges is only ever a key of joins that Spark can split.
    """

    def star(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.col("w")).alias("m"))
        return pairs.join(least, F.col("u") == F.col("w"))

    def tidy(pairs: DataFrame) -> DataFrame:
        return pairs.filter("a != b").distinct()

    def mark(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = materialize(tidy(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "edges")
    before = None
    while (found := mark(now)) != before:
        before = found
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = star(both).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = materialize(tidy(large), "large-star")
        # each edge now runs from the larger node to the smaller
        down = star(large.select(F.col("a").alias("u"), F.col("b").alias("v")))
        small = down.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        now = materialize(tidy(small), "small-star")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels after joining the classes of a[i] and b[i]; a label is the smallest position of its class."""
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return labels
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        to = np.arange(len(labels))
        np.minimum.at(to, np.maximum(la, lb), np.minimum(la, lb))
        while (to[to] != to).any():
            to = to[to]
        labels = to[labels]
