"""Connected components by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import settle

#: Edges of one partition, and the edges from which the minima of a round are written before they are joined.
PART_EDGES, MANY_EDGES = 200_000, 2_000_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); root is the component's smallest node.

    Each round hangs every neighbour larger than a node onto the smallest
    neighbour, then does the same among the smaller ones; the edges shrink to
    one star a component in a logarithmic number of rounds. Each round is
    checkpointed. Minima are combined before the shuffle. Where edges are many,
    the minima are checkpointed too: then both sides of the joins back are plain
    shuffles, which Spark may split where a node is hot. Few edges are kept in few
    partitions. Self-loops, repeated edges and nulls are ignored.
    """
    now = settle(
        edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    size, mark = now.count(), None
    while size:
        hold = settle if size > MANY_EDGES else lambda x: x
        parts = max(4, size // PART_EDGES)
        if mark is None:
            now = now.coalesce(parts)
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = hold(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = hold(both.filter(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        least = hold(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = settle(small.unionAll(least.select("a", F.col("m").alias("b"))).distinct().coalesce(parts))
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if seen == mark:
            break
        size, mark = seen["n"], seen
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots.select("node", F.col("node").alias("root")))
