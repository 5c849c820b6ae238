"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def _star(edges: DataFrame) -> DataFrame:
    """Each row ``(a, b)`` becomes ``(b, smallest neighbour of a, a included)``. Minima are partial before the shuffle."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a"), F.least("a", "m").alias("m"))
    return edges.join(least, "a").select("a", "b", "m")


def _settled(edges: DataFrame) -> bool:
    """Whether edges from a larger to a smaller node are stars: each leaf has one edge, and no centre is a leaf."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("b", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.filter("up > 1 OR up = 1 AND down = 1").agg(F.count("*")).first()[0] == 0


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 64) -> DataFrame:
    """``node, root`` for every node on an edge; ``root`` is the smallest node it reaches.

    Edges may repeat and may join a node to itself; nulls are left out. Rounds are logarithmic in the longest path
    and end once only stars are left, and every round's edges are settled in the shared folder. No component is ever gathered in one place.
    """
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    now = settle(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    nodes = now.select(F.col("a").alias("node")).union(now.select("b")).distinct()
    now, rounds = now.filter("a <> b"), 0
    while not _settled(now):
        if rounds == max_rounds:
            raise RuntimeError("components did not settle")
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small = _star(large)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        now, rounds = settle(small.filter("a <> b").distinct()), rounds + 1
    root = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.join(root, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def joined_components(roots: DataFrame, edges: DataFrame, node: str, a: str, b: str) -> DataFrame:
    """``roots`` (``node, root``, one row a node) after more ``edges``. Only edges between roots go through rounds.

    A node that ``roots`` lacks is its own root so far.
    """
    for end in (a, b):
        known = roots.select(F.col(node).alias(end), F.col("root").alias("_root"))
        edges = edges.select(a, b).join(known, end, "left").withColumn(end, F.coalesce("_root", end))
    changed = settle(connected_components(edges.select(a, b).filter(F.col(a) != F.col(b)).distinct(), a, b))
    moved = roots.join(changed.select(F.col("node").alias("root"), F.col("root").alias("_to")), "root", "left")
    new = changed.select(F.col("node").alias(node), "root").join(roots.select(node), node, "left_anti")
    return moved.select(node, F.coalesce("_to", "root").alias("root")).unionByName(new)
