"""How many of the expected issues a review found."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECALL_FLOOR = 0.75  # fixed value: share that must be found

KEYS = ("repo", "function_name")


def found_functions(findings: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return findings.select(*keys).distinct()


def hits(findings: DataFrame, expected: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Expected functions that were found."""
    return expected.select(*keys).intersect(findings.select(*keys))


def missed(findings: DataFrame, expected: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Expected functions that were not found."""
    return expected.select(*keys).subtract(findings.select(*keys))


def expected_found(findings: DataFrame, expected: DataFrame,
                   keys: Sequence[str] = KEYS) -> DataFrame:
    """Expected issues joined with the functions found, by name."""
    return expected.join(found_functions(findings, keys), list(keys))


def recall(findings: DataFrame, expected: DataFrame, by: Sequence[str] = (),
           keys: Sequence[str] = KEYS) -> DataFrame:
    """Expected, found, recall and whether it reaches the floor, overall or per `by`."""
    found = found_functions(findings, keys).withColumn("_found", F.lit(True))
    wanted = expected.select(*keys).distinct()
    counts = wanted.join(found, list(keys), "left").groupBy(*by).agg(
        F.count("*").alias("expected"), F.count("_found").alias("found"))
    share = F.try_divide(F.col("found"), F.col("expected"))
    return counts.select(*by, "expected", "found", share.alias("recall"),
                         (share >= RECALL_FLOOR).alias("passed"))
