"""Connected components of a graph whose edges don't fit one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskforge.llm.common import written

MAX_ROUNDS = 60


def _larger_first(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _star(pairs: DataFrame) -> DataFrame:
    """Of (u, v) pairs: with m the least of u and its v, all v and u linked to m."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (u, v): the least node that it reaches.

    Large-star and small-star steps in turn, each a grouped minimum and a join,
    until the edges stay the same; every round is written, so none is done again.
    Nulls must not occur; loops and repeated edges are ignored.
    """
    now = written(_larger_first(edges), "edges")
    state = None
    for _ in range(MAX_ROUNDS):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            break
        state = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = _larger_first(large)
        small = _star(large)
        now = written(_larger_first(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))), "edges")
    else:
        raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
