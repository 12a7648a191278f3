"""Connected components by alternating large-star and small-star steps (joins and grouping only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from context_shaper.session import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour (or itself)."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the smallest of them; here v < u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node that an edge (u, v) names; the component is its smallest id.

    Nodes without links are not listed.  Each round is written to the shared folder, so lineage
    stays short and a lost executor repeats one round only.  Grouping keeps one number per node,
    so a node with very many links is combined before the shuffle and its join can be split.
    """
    ordered = edges.filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).distinct()
    current = stage(ordered, "links")
    before = None
    while True:
        current = stage(_small_star(_large_star(current)), "links")
        now = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    spokes = current.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return spokes.union(spokes.select("component", "component").distinct().toDF("id", "component"))
