"""Connected components of a graph given as a table of links.

Alternating stars: the large star links every larger neighbour of a node to the node's smallest
neighbour, the small star does so with the smaller ones. Each round is two grouped minima and two
joins; the links never leave the cluster, and a node with many links is a hot join key, which
adaptive execution splits. Rounds grow with the logarithm of the largest component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stage


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, root) for every node of a link, the root being the smallest node reachable.

    Links may repeat and lead from a node to itself; those with a null end are left out. No links
    give no rows.
    """
    down = stage(_downward(links.select(F.col(a).alias("u"), F.col(b).alias("v"))), "links")
    seen = None
    while True:
        state = down.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
                         .alias("h")).first()
        if state.n == 0 or (state.n, state.h) == seen:
            break
        seen = (state.n, state.h)
        down = stage(_small_star(_large_star(down)), "links")
    roots = down.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select("root", "root").distinct())


def _downward(links: DataFrame) -> DataFrame:
    """Every link once, from its larger node u to its smaller node v."""
    return links.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(down: DataFrame) -> DataFrame:
    both = down.union(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _downward(both.where("v > u").join(least, "u").select(F.col("v").alias("u"),
                                                                 F.col("m").alias("v")))


def _small_star(down: DataFrame) -> DataFrame:
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _downward(moved.union(least.select("u", F.col("m").alias("v"))))
