"""Addresses of repositories to scan."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import clean_url, is_repo_url, repo_slug

EXPECTED = "Expected format: https://github.com/owner/repository"


def check_targets(targets: DataFrame, col: str = "repo_url") -> DataFrame:
    """Clean the address; add `slug` for a valid one and `error` for any other."""
    url = F.col(col)
    valid = is_repo_url(url)
    message = F.concat(F.lit("Invalid GitHub URL format: '"), url, F.lit(f"'. {EXPECTED}"))
    return (
        targets.withColumn(col, clean_url(F.coalesce(url, F.lit(""))))
        .withColumn("slug", F.when(valid, repo_slug(url)))
        .withColumn("error", F.when(~valid, message))
    )


def validate_targets(targets: DataFrame, col: str = "repo_url") -> tuple[DataFrame, DataFrame]:
    """(accepted with `slug`, rejected with `error`)."""
    checked = check_targets(targets, col)
    return (checked.filter(F.col("error").isNull()).drop("error"),
            checked.filter(F.col("error").isNotNull()).drop("slug"))
