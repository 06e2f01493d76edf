"""Review comments prepared for a pull request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scoring import severity_rank

MAX_COMMENTS = 10  # fixed value: default number of findings considered


def comment_body() -> Column:
    flag = F.when(F.col("needs_verification"), " — ⚠️ Verify before acting").otherwise("")
    return F.concat(
        F.lit("**[AI Code Review] "), F.col("issue_category"), F.lit(" — "), F.col("severity"),
        F.lit(" Severity**\n\n"), F.col("comment"), F.lit("\n\n**Suggested fix:** "),
        F.col("suggested_fix"), F.lit("\n\n*Confidence: "),
        F.col("confidence_score").cast("string"), F.lit("%"), flag, F.lit("*"),
    )


def plan_pr_comments(findings: DataFrame, pr_files: DataFrame,
                     max_comments: int = MAX_COMMENTS) -> DataFrame:
    """The worst `max_comments` findings per repo, planned if their file is part of the change
    (`pr_files(repo, file_path[, commit_id])`), else skipped.

    The cap comes before the file test. It is a rank filter, so each task forwards at most
    max_comments rows per repo.
    """
    order = W.partitionBy("repo").orderBy(severity_rank(F.col("severity")), "idx")
    worst = findings.withColumn("position", F.row_number().over(order)).filter(
        F.col("position") <= max_comments)
    if "commit_id" not in pr_files.columns:
        pr_files = pr_files.withColumn("commit_id", F.lit(None).cast("string"))
    # a file counts once, with one of its commits
    changed = pr_files.groupBy("repo", "file_path").agg(
        F.max("commit_id").alias("commit_id"), F.lit(True).alias("_changed"))
    return worst.join(changed, ["repo", "file_path"], "left").select(
        "repo", "position", "idx",
        F.when(F.col("_changed"), "planned").otherwise("skipped").alias("status"),
        F.col("file_path").alias("path"), F.col("line_number").alias("line"),
        F.lit("RIGHT").alias("side"), "commit_id", comment_body().alias("body"),
    )


def findings_in_pr(findings: DataFrame, pr_files: DataFrame) -> DataFrame:
    """Findings in files of the change."""
    return findings.join(pr_files.select("repo", "file_path"), ["repo", "file_path"], "left_semi")


def pr_outcome(plan: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Comments posted, skipped and failed per repo. `failed(repo, idx)` lists planned
    comments a client could not post; without it every planned one counts as posted."""
    if failed is None:
        plan = plan.withColumn("_failed", F.lit(False))
    else:
        marks = failed.select("repo", "idx").distinct().withColumn("_failed", F.lit(True))
        plan = plan.join(marks, ["repo", "idx"], "left").fillna(False, ["_failed"])
    planned = F.col("status") == "planned"
    return plan.groupBy("repo").agg(
        F.count_if(planned & ~F.col("_failed")).alias("posted"),
        F.count_if(~planned).alias("skipped"),
        F.count_if(planned & F.col("_failed")).alias("failed"),
    )
