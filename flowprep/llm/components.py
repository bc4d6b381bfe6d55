"""Connected components of a link table, in Spark.

Large-star / small-star: every round each node hands its neighbours to the
smallest node it knows, until the links form stars.  A node's smallest neighbour
is a partial aggregate and is joined back on the node, so a hub's links are
never gathered in one task (adaptive execution splits the join's hub side).
Each round is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n nodes linked by (a, b): hooking and pointer jumping."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        while (root != (jumped := root[root])).any():
            root = jumped
        if (root == before).all():
            return root


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b: orderable, not null); root: the smallest it reaches."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = stored(edges.where("a <> b").select(low.alias("a"), high.alias("b")).distinct(), "links")
    seen = _state(now)
    while seen[0]:
        # large star: each node links its larger neighbours to its smallest one
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
                 .where("a <> b").distinct())
        # small star: each node links its smaller neighbours, and itself, to the smallest of them
        large = stored(large, "links")
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (large.join(least, "b")
                 .select(F.explode(F.array(F.struct(F.col("m"), F.col("a").alias("n")),
                                           F.struct(F.col("m"), F.col("b").alias("n")))).alias("e"))
                 .select(F.col("e.m").alias("a"), F.col("e.n").alias("b")).where("a <> b").distinct())
        now = stored(small, "links")
        state = _state(now)
        if state == seen:
            break
        seen = state
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
