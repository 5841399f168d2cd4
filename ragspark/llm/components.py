"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", most: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) of each node that has an edge; `edges`: a, b (longs).

    Each step joins every node to the smallest of its neighbours and itself; hubs are a row a task
    after the partial minimum. The minima are tables of their own, so that both sides of the join
    back are plain shuffles, which can be split where a hub makes one large. Steps are tables in the
    shared folder, so a lost executor costs a task; the number of steps grows with the logarithm of
    the graph's diameter. Ends when a step changes nothing.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    now, before, old = scratch.save(now, f"{name}0"), None, f"{name}0"
    for step in range(most):
        # Large-star: each neighbour above a node moves to the smallest node around.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-least")
        large = scratch.save(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{name}-large")
        # Small-star: a node and its neighbours below it move to the smallest of them.
        lower = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-lower")
        small = large.join(lower, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.select("u", F.col("m").alias("v"))).distinct()
        now = scratch.save(small, f"{name}{step + 1}")
        scratch.drop(old, f"{name}-least", f"{name}-large", f"{name}-lower")
        old = f"{name}{step + 1}"
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.min("u"), F.max("v")).first()
        if state == before or not state[0]:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
