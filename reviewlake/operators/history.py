"""Scan history: latest scans and the trend between the last two."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def recent_scans(history: DataFrame, n: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """Last `n` scans, newest first, overall or per key; at most n rows per key and task move."""
    if not by:
        return history.orderBy(F.desc("ts")).limit(n)
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("ts")))
    return history.withColumn("recency", rank).filter(F.col("recency") <= n)


def trend(history: DataFrame, scope: str = "global") -> DataFrame:
    """Change from the last scan but one to the last.

    `global` compares the last two scans of all and gives a row only if both are of one repo;
    `repo` compares the last two of every repo. Both look at two rows per group only.
    """
    if scope == "global":
        two = recent_scans(history, 2).withColumn(
            "recency", F.row_number().over(W.orderBy(F.desc("ts"))))
        keys: list[str] = []
    elif scope == "repo":
        two, keys = recent_scans(history, 2, ["repo"]), ["repo"]
    else:
        raise ValueError(f"unknown scope {scope!r}")
    last, before = F.col("recency") == 1, F.col("recency") == 2
    pair = two.groupBy(*keys).agg(
        F.max(F.when(last, F.col("repo"))).alias("_repo"),
        F.max(F.when(before, F.col("repo"))).alias("_repo_before"),
        F.max(F.when(last, F.col("findings"))).alias("findings"),
        F.max(F.when(before, F.col("findings"))).alias("previous"),
    ).filter(F.col("_repo") == F.col("_repo_before"))
    delta = F.col("previous") - F.col("findings")

    def by_sign(better: str, worse: str, same: str):
        return F.when(delta > 0, better).when(delta < 0, worse).otherwise(same)

    return pair.select(
        F.col("_repo").alias("repo"), "findings", "previous", delta.alias("delta"),
        by_sign("improving", "degrading", "stable").alias("trend"),
        by_sign("↓", "↑", "→").alias("symbol"),
        by_sign("#22C55E", "#EF4444", "#F5A623").alias("color"),
        F.concat(F.abs(delta).cast("string"), F.lit(" findings "),
                 by_sign("fewer", "more", "more"), F.lit(" than last scan")).alias("text"),
    )
