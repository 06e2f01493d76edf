"""Health score of a repository."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..session import materialize
from .findings import finding_key


def latest_feedback(feedback: DataFrame, order: Sequence[str] = ("ts",)) -> DataFrame:
    """Last verdict per (repo, finding_key); `order` must tell any two writes apart."""
    return feedback.groupBy("repo", "finding_key").agg(
        F.max_by("verdict", F.struct(*order)).alias("verdict"))


def false_positives(latest: DataFrame) -> DataFrame:
    return latest.filter(F.col("verdict") == "false_positive").select("repo", "finding_key")


def drop_false_positives(findings: DataFrame, latest: DataFrame) -> DataFrame:
    """Findings whose latest verdict is not false_positive.

    The dismissed keys are written first: a join with the grouped verdicts themselves could not
    be split where one key holds many findings.
    """
    keyed = findings.withColumn("finding_key", finding_key())
    dismissed = materialize(false_positives(latest), "dismissed")
    return keyed.join(dismissed, ["repo", "finding_key"], "left_anti")


def penalty_hundredths() -> Column:
    """Weight times confidence, in exact hundredths of a point."""
    weight = scoring.severity_weight(F.col("severity"))
    return (weight * F.col("confidence_score")).cast("long")


def health(findings: DataFrame, latest: DataFrame | None = None,
           grade_on: str = "raw", repos: DataFrame | None = None) -> DataFrame:
    """Per repo: score, grade, color.

    Of `repos` if given, one without findings at 100; else of the repos with findings.

    With feedback, penalties are first summed per finding key, so a key shared by many findings
    meets its verdict as one row and the join cannot be skewed. A repo whose findings are all
    false positives keeps its row, at 100.
    """
    scored = findings.select("repo", finding_key().alias("finding_key"),
                             penalty_hundredths().alias("penalty"))
    if latest is not None:
        dismissed = false_positives(latest).withColumn("_dismissed", F.lit(True))
        per_key = scored.groupBy("repo", "finding_key").agg(F.sum("penalty").alias("penalty"))
        scored = per_key.join(dismissed, ["repo", "finding_key"], "left").withColumn(
            "penalty", F.when(F.col("_dismissed"), F.lit(0)).otherwise(F.col("penalty")))
    total = scored.groupBy("repo").agg(F.sum("penalty").alias("penalty"))
    if repos is not None:
        total = repos.select("repo").distinct().join(total, "repo", "left")
    return total.select("repo", *score_columns(F.col("penalty"), grade_on))


def score_columns(penalty: Column, grade_on: str = "raw") -> list[Column]:
    """score, grade and color of a penalty in hundredths; NULL penalty counts as none."""
    raw = (F.lit(10000) - F.least(F.coalesce(penalty, F.lit(0)), F.lit(10000))) / F.lit(100)
    score = scoring.round_to_int(raw)
    basis = {"raw": raw, "rounded": score}[grade_on]
    return [score.alias("score"), scoring.grade(basis).alias("grade"),
            scoring.grade_color(basis).alias("color")]
