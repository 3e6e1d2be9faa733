"""Connected components of an undirected graph whose edges are rows, by contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, member) of every node of the edges a-b that isn't the least of its component: as connected, and never more edges than nodes."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        lu, lv = label[u], label[v]
        open_ = lu != lv
        if not open_.any():
            break
        np.minimum.at(label, np.maximum(lu, lv)[open_], np.minimum(lu, lv)[open_])
        while not np.array_equal(label, up := label[label]):
            label = up
    member = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[member]], nodes[member]


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node of its component, for every node of edges (a, b); empty for no edges.

    Each round labels a node with the least of itself and its neighbours, follows the labels twice more, and replaces
    both ends of every edge by their labels; edges within one label go. Rounds are written to the shared folder, so none
    is computed again. A round's work is joins on single nodes against one label each, so a node with very many
    edges is a skewed join, which adaptive execution splits.
    """
    rest = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    total = None
    while not rest.isEmpty():
        both = rest.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(rest.select("b", "a"))
        label = cut(both.groupBy("node").agg(F.least("node", F.min("other")).alias("root")), "labels")
        for _ in range(2):
            up = label.select(F.col("node").alias("root"), F.col("root").alias("next"))
            label = label.join(up, "root").select("node", F.col("next").alias("root"))
        label = cut(label, "labels")
        total = label if total is None else cut(
            total.join(label.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots"
        )
        a, b = (label.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
        moved = rest.join(a, "a").join(b, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        rest = cut(moved.where("a <> b").distinct(), "edges")
    if total is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    return total
