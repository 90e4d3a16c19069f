"""Connected components of a graph given by its edges, with tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.llm.shared import store


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie every larger neighbour of a node to the node's least neighbour (or itself)."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie a node and its smaller neighbours to the least of them. Edges run from the larger to the smaller node."""
    least = edges.groupBy("a").agg(F.min("b").alias("low"))
    joined = edges.join(least, "a").filter("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return joined.unionAll(least.select("a", F.col("low").alias("b")))


def components(edges: DataFrame, turns: int = 60) -> DataFrame:
    """(node, component): the least node of its component, for every node that has an edge and is not that node itself.

    Large-star and small-star steps in turn until nothing changes; the number of turns grows with the logarithm
    of the longest path. Each turn is stored, so a lost executor repeats one turn at most. ``edges`` has the
    columns a and b; loops and repeated edges do no harm, an empty table gives no rows.
    """
    edges = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, before = store(edges, "edges"), None
    for _ in range(turns):
        state = tuple(current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if state == before or not state[0]:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = state
        current = store(_small_star(_large_star(current).distinct()).distinct(), "edges")
    raise RuntimeError(f"components have not settled after {turns} turns")
