"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """From links (a, b) of longs: (node, root), root being the least node reachable; nodes without links are absent.

    A round is two aggregates and two joins, so no neighbourhood is gathered in one place. The aggregates are
    written before they are joined: then a hub with very many links is a skewed side of a plain join, which
    adaptive execution splits. It ends when each link leads from a node to its root.

    Defined cases: links of a node with itself and repeated links count for nothing; links may be given either
    way round; a null end drops the link; an empty table gives no rows; further columns are ignored.
    """
    up, down = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    links = scratch.cut(edges.where("a <> b").select(up, down).distinct())
    while True:
        # each node's least smaller neighbour, and how many smaller ones it has
        least = scratch.cut(links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        above = least.select(F.col("a").alias("b"), F.col("m").alias("m"))
        if least.where("n > 1").isEmpty() and links.join(above, "b", "left_semi").isEmpty():
            scratch.drop(least)
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        # large-star: a node's larger neighbours go to the least of all its neighbours and itself
        large = scratch.cut(links.join(above, "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct())
        scratch.drop(least, links)
        # small-star: a node and its smaller neighbours go to the least of them
        least = scratch.cut(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        small = large.join(least.where("n > 1").select("a", "m"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = scratch.cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        scratch.drop(least, large)
