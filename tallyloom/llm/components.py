"""Connected components of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.kit import drop, written

#: Rounds after which something is wrong: they grow with the square of the logarithm of the longest path at most.
MOST_ROUNDS = 60


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b) that is not its component's smallest; that one is the root.

    Self links count nothing, links may repeat. Nodes must be comparable and not null.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges, at = written(edges)
    told = None
    for _ in range(MOST_ROUNDS):
        more, to = written(_small(_large(edges).distinct()).distinct())
        now = more.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        drop(edges.sparkSession, at)
        edges, at = more, to
        if told == now:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        told = now
    raise RuntimeError("the components did not settle")
