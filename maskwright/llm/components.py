"""Connected components by alternating stars, on tables alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import discard, lookup, materialize


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's greater neighbours, linked to the least node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), "stars")
    return lookup(both, least, "u", "n", "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its lesser neighbours, linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialize(down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "stars")
    out = lookup(down, least, "u", "n", "v").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (u long, v long) but the roots; the root is its component's least node.

    Stars only shrink the number of edges, and rounds grow with the logarithm of a component's size. A hub's edges
    never meet in one task: minima are summed up before the shuffle, and brought back by ``lookup``.
    """
    edges = materialize(edges.where("u <> v").select("u", "v").distinct(), "edges")
    last = _sum(edges)
    while last[0]:
        wide = materialize(_large_star(edges), "edges")
        narrow = materialize(_small_star(wide), "edges")
        discard(edges, wide)
        edges, now = narrow, _sum(narrow)
        if now == last:
            break
        last = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
