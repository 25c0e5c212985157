"""Connected components over edge tables, and over edges within a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from vernissage.session import materialize


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For ``n`` nodes, the smallest node that each can reach over the edges ``left[i]``-``right[i]``."""
    label = np.arange(n)
    while True:
        a, b = label[left], label[right]
        low = np.minimum(a, b)
        if np.array_equal(a, b):
            return label
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while not np.array_equal(label, next_label := label[label]):
            label = next_label


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``a``, ``b``: bigint), the component being its smallest node.

    Alternates the large-star and small-star steps until the edges stop changing, which takes few rounds even for long
    chains. Minima are combined before their shuffle; each round is a written table, so a lost executor costs one round at
    most. Loops and repeated edges do no harm; edges with a null end are ignored; no edges give no rows.
    """
    edges = edges.filter("a is not null and b is not null and a <> b")
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large.filter("a <> b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        rest = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(low.select("a", F.col("m").alias("b")).unionByName(rest).distinct())
        now = _state(edges)
        if now == before:
            break
        before = now
    heads = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(heads)
