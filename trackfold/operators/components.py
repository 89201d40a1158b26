"""Connected components by star contraction.

Two steps take turns.  The large step links the larger neighbours of each node with the smallest node in its reach, the
small step does so with the smaller ones; edges stay edges between nodes of one component, and the number of rounds grows
with the logarithm of a component's size, however long its paths are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import saved


def smallest_nodes(part: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """For each edge (a, b) of a part: the smallest node of its component among these edges, the component's number, and
    the numbers of both nodes.

    Roots hook onto smaller ones and pointers are halved until every edge lies below one root.
    """
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    nodes, at = np.unique(np.concatenate([part, part]).astype(np.int64) * len(names) + at, return_inverse=True)
    root = np.arange(len(nodes))
    x, y = ends = np.split(at, 2)
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = low < high
        x, y = x[apart], y[apart]
        np.minimum.at(root, high[apart], low[apart])
        above = root[root]
        while not np.array_equal(above, root):
            root, above = above, above[above]
    group = root[ends[0]]
    return names[nodes[group] % max(len(names), 1)], group, tuple(ends)


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("part", F.col("high").alias("u"), F.col("low").alias("v")).unionByName(edges.select("part", F.col("low").alias("u"), F.col("high").alias("v")))
    least = both.groupBy("part", "u").agg(F.least("u", F.min("v")).alias("m"))
    return both.join(least, ["part", "u"]).where("v > u").select("part", F.col("v").alias("high"), F.col("m").alias("low")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("part", "high").agg(F.min("low").alias("m"))
    lower = edges.join(least, ["part", "high"]).where("low <> m").select("part", F.col("low").alias("high"), F.col("m").alias("low"))
    return lower.unionByName(least.select("part", "high", F.col("m").alias("low"))).distinct()


def _print(edges: DataFrame) -> tuple:
    """What tells two sets of edges apart: their number and two sums of hashes."""
    h = F.xxhash64("part", "high", "low")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 30)))).first())


def components(edges: DataFrame) -> DataFrame:
    """(part, node, root) for the nodes of ``edges`` (part, a, b): the smallest node of each one's component.

    Parts are apart from each other.  Each round is written to the shared folder; one that changes nothing is the last.
    """
    loops = edges.where("a = b").select("part", F.col("a").alias("node"))
    now = saved(edges.where("a <> b").select("part", F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct())
    seen = _print(now)
    while seen[0]:
        now = saved(_small(_large(now)))
        before, seen = seen, _print(now)
        if seen == before:
            break
    stars = now.select("part", F.col("high").alias("node"), F.col("low").alias("root"))
    alone = loops.select("part", "node", F.col("node").alias("root"))
    roots = now.select("part", F.col("low").alias("node"), F.col("low").alias("root"))
    return stars.unionByName(roots).unionByName(alone).groupBy("part", "node").agg(F.min("root").alias("root"))
