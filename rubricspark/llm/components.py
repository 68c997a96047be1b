"""Connected components of an edge table by alternating stars, and of small edge sets in numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long): root is the smallest node that it reaches.

    Large-star and small-star steps alternate until every edge points from a node to its root; the number of rounds
    grows with the logarithm of the longest chain. Each round is written to the shared folder, so a lost executor
    costs one round at most. Loops and repeated edges do no harm; no edges give no rows.
    """
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: the neighbours above a node hang on the least of its neighbours and itself
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the neighbours below a node, and the node, hang on the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        before, now = now, materialize(small.filter("u <> v").distinct())
        discard(before)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def spanning_links(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[list[int], list[int]]:
    """Links of a spanning forest over items 0..n-1. near(i, others): which of the others link with i.

    Items that a search has reached are never looked at again, so a dense group costs about its size, not its square.
    """
    rest, out_a, out_b = np.arange(n), [], []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = near(i, rest)
            if hit.any():
                found = rest[hit]
                out_a += [i] * len(found)
                out_b += found.tolist()
                queue += found.tolist()
                rest = rest[~hit]
    return out_a, out_b
