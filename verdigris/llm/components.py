"""Connected components of a distributed graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import durable, join_groups


def _fingerprint(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b") % F.lit(1 << 40)), F.lit(0))).first())


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, label) of every node that has an edge (a, b): label is the smallest node of its component.

    Each round re-hangs edges onto the smallest neighbour (large star: larger neighbours; small star: smaller ones)
    until every edge points at its component's smallest node; rounds grow with the logarithm of the longest path.
    `rows` is a bound of the edges, if one is known. A node's neighbours are never gathered: only their minimum is, by partial aggregation, and joined back.
    """
    now = durable(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", rows)
    before = None
    while (state := _fingerprint(now)) != before and state[0]:
        before, rows = state, 2 * state[0]
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = durable(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_n")).select("a", F.least("a", "m").alias("m"), "_n"), "least")
        # a root that very many edges hang on is broadcast with its minimum, not shuffled
        large = join_groups(both.filter("b > a"), least, ["a"], "_n").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        large = durable(large, "large", rows)
        least = durable(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_n")), "least", rows)
        joined = join_groups(large, least, ["a"], "_n")
        small = joined.filter("b != m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = durable(small.distinct(), "small", rows)
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
