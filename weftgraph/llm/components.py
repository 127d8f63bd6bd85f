"""Connected components by alternating star contraction, without collecting nodes or links anywhere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def star_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest reachable index of each of n local nodes, given links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)  # also moves what hangs on the old labels
        np.minimum.at(new, label[b], low)
        new = new[new[new]]
        if (new == label).all():
            return label
        label = new


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b"))).first())


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of all nodes in `links` (columns a and b, long): root is the smallest node reachable.

    Each round hooks larger neighbours, then smaller ones, onto the smallest neighbour of a node; the number of rounds
    grows with the logarithm of the longest chain. Every step is a join or a partial aggregate on a node, where AQE can
    split a hub; each round is written to shared storage, so that lineage stays short.
    """
    edges = scratch.save(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    while state[0]:
        low = edges.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        large = edges.join(low, F.col("b") == F.col("k"), "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        hooked = scratch.save(large)
        low = hooked.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        small = hooked.join(low, F.col("a") == F.col("k")).select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).where("a <> b")
        new = scratch.save(small.unionByName(low.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct())
        scratch.drop(hooked)
        scratch.drop(edges)
        edges, before, state = new, state, _state(new)
        if state == before:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
