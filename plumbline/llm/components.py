"""Connected components by alternating stars, as joins and aggregates.

The edges of a large component are a star around one node; joins by that node send its row to
the edges and not the edges to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import BROADCAST_PAIRS, cut, joined

EDGES_IN_PART = 100_000


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return joined(both.where("v > u"), least, ["u"], most=BROADCAST_PAIRS).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its neighbours below are tied to the smallest of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = cut(down.groupBy("u").agg(F.min("v").alias("m")))
    across = joined(down, least, ["u"], most=BROADCAST_PAIRS).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return across.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v) that is not itself the smallest of its component.

    Each round halves the depth of the trees; rounds end when the edges no longer change. The
    edges of a round are checkpointed, so a lost executor costs no earlier round; they stand in
    as many partitions as their number asks for.
    """
    now = cut(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    was, held = None, state(now)
    while held != was and held[0]:
        parts = 1 + held[0] // EDGES_IN_PART
        now = cut(_small_star(cut(_large_star(now.coalesce(parts)).coalesce(parts))).coalesce(parts))
        was, held = held, state(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
