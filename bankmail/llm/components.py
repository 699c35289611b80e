"""Connected components of a written table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bankmail.llm.base import materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node; root is the least node reachable. `links` has columns a and b.

    Each round links the larger neighbours of every node to its least neighbour, then the smaller ones; the
    number of rounds grows with the logarithm of the longest chain. A round is one written table: its two steps share their
    shuffle. Minima have a partial step, and Spark splits the joins at nodes with very many links.
    """
    pair = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    edges = materialize(links.where("a <> b").select(*pair).distinct(), "links")
    state = _state(edges)
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(least, "b").select("a", "b", "m")
        small = joined.select(F.col("m").alias("a"), "b").union(joined.where("a <> m").select(F.col("m"), F.col("a")))
        edges = materialize(small.distinct(), "links")
        before, state = state, _state(edges)
        if state == before:
            roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
            return roots.union(edges.select(F.col("a"), F.col("a")).distinct())
