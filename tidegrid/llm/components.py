"""Connected components of a link table, by alternating stars; nothing is gathered on the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.tables import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the smallest neighbour of the node."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("low"))
    kept = down.join(least, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return kept.union(least.select("a", F.col("low").alias("b"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``a, b`` (long) links -> ``node, root``, the smallest node of its component, for every node with a link but the roots.

    Self-links and nulls are ignored, repeated links count once. Each round writes its edges to the shared folder; the work
    of a round is in proportion to the edges, and star-like groups of any size end in two or three rounds.
    """
    current = stored(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    mark = None
    for _ in range(most_rounds):
        current = stored(_small_star(_large_star(current)), "edges")
        seen = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
