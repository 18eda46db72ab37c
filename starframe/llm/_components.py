"""Connected components of a graph given by its edges, by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starframe.llm._shared import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours (the larger ones, or the smaller ones and itself) to its least neighbour.

    Minima are aggregated before the shuffle, and the join on a hub can be split, so a hub needs no task of its own.
    """
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))  # both directions: (node, neighbour)
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = near.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = near.groupBy("a").agg(F.min("b").alias("m"))
        down = near.join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
        out = down.unionByName(least.select(F.col("a").alias("x"), F.col("m").alias("y")))
    return out.where(F.col("x") != F.col("y")).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node of its component.

    Loops and repeated edges are allowed; nodes may be of any ordered type.  The work is a few shuffles of the edges a round, and
    the number of rounds grows with the logarithm of the number of nodes; what decides the end are two numbers.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(rounds):
        after = cut(_star(_star(now, True), False))
        found = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now = after
        if found == state:
            break
        state = found
    else:
        raise RuntimeError("components: no end after the given number of rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
