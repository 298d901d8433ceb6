"""Connected components of links, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.common import Scratch


def components(spark: SparkSession, scratch: Scratch, links: DataFrame) -> DataFrame:
    """(node, root) for each node of the links (a, b): root is the smallest node it is connected to.

    Rounds of contraction: each node moves onto its neighbour of smallest hash, links between what has become
    one node go, and the rest are renamed. A share of the nodes vanishes in each round, so their number grows
    with the logarithm of the longest chain. All group-bys combine before the shuffle, and every join is
    of two saved tables, one of which has a row for each key: Spark can split a hub among tasks.
    """
    e = scratch.save(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    nodes = scratch.save(e.select(F.col("a").alias("node")).union(e.select("b")).distinct().withColumn("label", F.col("node")))
    round_ = 0
    while not e.isEmpty():
        order = lambda c: F.xxhash64(F.col(c), F.lit(round_))
        both = e.union(e.select("b", "a"))
        best = both.groupBy("a").agg(F.min(F.struct(order("b").alias("h"), F.col("b").alias("to"))).alias("m"))
        moves = scratch.save(best.where((F.col("m.h") < order("a")) | ((F.col("m.h") == order("a")) & (F.col("m.to") < F.col("a")))).select(F.col("a").alias("old"), F.col("m.to").alias("to")))
        half = scratch.save(e.join(moves, e["a"] == moves["old"], "left").select(F.coalesce("to", "a").alias("a"), "b"))
        whole = half.join(moves, half["b"] == moves["old"], "left").select("a", F.coalesce("to", "b").alias("b"))
        e = scratch.save(whole.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
        nodes = scratch.save(nodes.join(moves, nodes["label"] == moves["old"], "left").select("node", F.coalesce("to", "label").alias("label")))
        round_ += 1
    least = scratch.save(nodes.groupBy("label").agg(F.min("node").alias("root")))
    return nodes.join(least, "label").select("node", "root")


def forest(n: int, pairs) -> list[tuple[int, int]]:
    """Of the pairs of numbers below n, enough to connect what they connect: at most n - 1."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out
