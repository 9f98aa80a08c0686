"""Connected components by alternating large-star and small-star steps, all in DataFrames.

Each step is one grouped minimum and one join on the edges, in which the edges of a hub are dealt over many tasks; the
work table is checkpointed every round, so a lost executor costs at most one round. The number of rounds grows with the
logarithm of the longest path; they end as soon as all edges are stars, without a round that only shows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrail.llm.common import checkpoint, spread_join


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """Edges (a, b) with a > b, at most `total`. Large star: every larger neighbour of u goes to u's least neighbour;
    small star: u and its smaller neighbours do."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    joined = spread_join(both, least, "u", "n", 2 * total if large else total)
    if large:
        moved = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.filter("a > b").distinct()


def _shape(edges: DataFrame) -> tuple[int, bool]:
    """The number of distinct edges (a, b) with a > b, and whether they are stars: every node is a root, which stands
    in b only, or stands once in a and never in b."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    total, others = nodes.agg(F.sum("up"), F.count_if((F.col("up") > 0) & (F.col("n") > 1))).first()
    return total or 0, not others


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the least node of its component.

    Loops and repeated edges are fine; without edges the result is empty.
    """
    now = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    total, done = _shape(now)
    while not done:
        now = checkpoint(_star(_star(now, True, total), False, total))
        total, done = _shape(now)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
