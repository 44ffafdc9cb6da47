"""Connected components of a graph held as rows, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import checkpointed, swept


def _minima(least: DataFrame, split: bool) -> DataFrame:
    """Minima by node, apart from the shuffle they came from if ``split``, so that Spark can deal out a hub's edges that meet them."""
    return checkpointed(least) if split else least


def _large_star(edges: DataFrame, split: bool) -> DataFrame:
    """Every larger neighbour of u moves to the smallest node among u and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _minima(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), split)
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, split: bool) -> DataFrame:
    """With edges from larger u to smaller v: u and its smaller neighbours move to the smallest of them."""
    least = _minima(edges.groupBy("u").agg(F.min("v").alias("m")), split)
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(edges: DataFrame, rounds: int = 60, split_edges: int = 1_000_000) -> DataFrame:
    """Rows ``(node, component)`` for every node that has an edge; component is its smallest reachable node.

    ``edges`` has long columns u and v, in either direction, loops and repeats allowed, none null.  A round is
    two grouped minima joined back.  A hub's edges are combined before they are shuffled.  Beyond ``split_edges`` edges,
    which one task can join, the minima are checkpointed, so that the join reads two plain shuffles and Spark can split
    a hub's edges over tasks.  Each round is checkpointed.  Only two numbers a round come to the driver.  The rounds end when every node
    points straight at its root; ``rounds`` only guards against a bug and raises.
    """
    now = checkpointed(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = None
    for _ in range(rounds):
        # a checksum of the edge set: unchanged by a full round exactly when the stars are final
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if tuple(seen) == before or not seen["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = tuple(seen)
        split = seen["n"] > split_edges
        now = checkpointed(_small_star(_large_star(now, split).distinct(), split))
        swept(edges.sparkSession)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
