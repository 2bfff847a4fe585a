"""Connected components of a graph that only the executors hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import cut
from quillsift.session import plain_unions

#: Rounds grow with the logarithm of the longest chain; beyond this something is wrong.
MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b: two long columns); component is the smallest node reachable.

    Alternates large-star and small-star steps until the links no longer change. Each step is an aggregation with
    partial minima and a join that adaptive execution can split, so a hub costs no single task its links. Every round
    is cut by a checkpoint. Self-links, nulls, repeated and reversed links are allowed; nodes with only a self-link or
    none at all are not returned; no links give no rows.
    """
    plain_unions(edges.sparkSession)
    links = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        state = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
        if not state[0] or state == before:
            return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
                links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
            )
        before = state
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        links = cut(small.union(least.select("hi", F.col("m").alias("lo"))).distinct())
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
