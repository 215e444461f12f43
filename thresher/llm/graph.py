"""Connected components by alternating stars, as joins and aggregations over edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def star_edges(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n nodes and links a-b, the smallest node that each can reach."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(label, before):
            return label


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the same nodes as a-b: each node but the first of a component, tied to the first."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = star_edges(len(nodes), at[: len(a)], at[len(a) :])
    tied = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[tied], nodes[root[tied]]


def _towards_least(links: DataFrame, keep_higher: bool) -> DataFrame:
    """(u, v) rows: each v, and for the small star u as well, tied to the least of u's neighbours and u."""
    # Written before the join: then both sides are plain exchanges, and a hub's links can be split.
    least = cut(links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    joined = links.join(least, "u")
    if keep_higher:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """From links a-b of comparable nodes: node, root (the least node of its component).

    Nodes without links are not returned. Rounds grow with the logarithm of a component's
    size. Only two numbers a round reach the driver. Nulls are no nodes; no links, no rows.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now, seen = cut(pairs.distinct(), "links"), None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(_towards_least(both, keep_higher=True).distinct(), "links")
        small = cut(_towards_least(large, keep_higher=False).distinct(), "links")
        mark = small.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        for old in (now, large):
            drop_cut(old)
        now = small
        if tuple(mark) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(mark)
