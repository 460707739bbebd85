"""Connected components of a graph given by links, on Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.scratch import stored


def _state(edges: DataFrame) -> tuple:
    """Count and sum of hashes: alike for equal sets of edges."""
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), digest).first())


def roots(links: DataFrame, left: str, right: str) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for every node but the roots.

    Large-star and small-star steps take turns until all edges lead to a root; the rounds
    grow with the logarithm of the longest path. Minima are aggregates that combine before
    they shuffle; they and the edges are written tables, so that a join on a node with very
    many edges reads both sides from plain shuffles, which adaptive execution splits.
    """
    high, low = F.greatest(left, right), F.least(left, right)
    edges = stored(
        links.where(F.col(left) != F.col(right))
        .select(high.alias("u"), low.alias("v"))
        .distinct(),
        "edges",
    )
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "large")
        # v > u >= m: each larger neighbour goes to the least of the neighbourhood
        larger = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        large = stored(
            larger.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(),
            "edges",
        )
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "small")
        # the smaller neighbours, and the node itself, to the least of them
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = least.select("u", F.col("m").alias("v"))
        edges = stored(small.unionByName(own).distinct(), "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
