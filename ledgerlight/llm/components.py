"""Connected components by alternating star steps, each round stored in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerlight.llm.storage import stored


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (a, b) with a > b: neighbours move to the smallest of them (only smaller ones where not `large`)."""
    around = edges if not large else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = around.join(least, "a")
    if large:
        pairs = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        pairs = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return pairs.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node reachable, the node itself included.

    Null ends and loops are left out; repeated edges count once; without edges the result is empty.
    """
    edges = stored(edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    nodes, before = edges, None
    while True:
        edges = stored(star(star(edges, large=True), large=False), "edges")
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", F.lit(1), "a"))).first()
        if state == before:
            break
        before = state
    every = nodes.select(F.col("a").alias("node")).union(nodes.select("b")).distinct()
    return every.join(edges.select(F.col("a").alias("node"), "b"), "node", "left").select("node", F.coalesce("b", "node").alias("root"))
