"""Distributed union-find: connected components of an edge table.

Each round every node takes the smallest label among its neighbours and itself, then follows
the label of that label (pointer jumping), so chains collapse in a logarithmic number of
rounds.  Labels live in a written table between rounds; the driver only sees one count.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reachable.

    A node with very many neighbours is the hot key: the neighbour minimum is a partial
    aggregate, and the label lookup is a plain equi-join of two exchanged tables that adaptive
    execution splits.  Self loops and repeated or reversed edges are allowed; nulls are dropped."""
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    sym = stored(e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    table = stored(sym.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                   .select("node", F.least("node", "m").alias("component")), "cc-labels")
    labels = table
    while True:
        near = (sym.join(labels.select(F.col("node").alias("b"), "component"), "b")
                .groupBy("a").agg(F.min("component").alias("m")))
        step = (labels.join(near, labels["node"] == near["a"])
                .select("node", F.col("component").alias("was"), F.least("component", "m").alias("c")))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("j"))
        after = stored(step.join(jump, "c", "left")
                       .select("node", "was", F.least("c", "j").alias("component")), "cc-labels")
        release(table)
        table, labels = after, after.select("node", "component")
        if after.filter("component <> was").isEmpty():
            release(sym)
            return labels


def local_components(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index reachable for each of n items, given index pairs, inside one task."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = np.minimum(label, label[label])
        if np.array_equal(before, label):
            break
    return label
