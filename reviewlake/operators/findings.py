"""Checks, filters and report tables over findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.cwe import with_cwe
from ..functions.paths import base_name
from ..schemas import CATEGORIES, FINDING_COLUMNS, SEVERITIES
from .positions import number_rows

LIST_PAGE = 1000  # findings held in one list cell


def normalize_findings(findings: DataFrame, confidence: str = "confidence_score") -> DataFrame:
    """Clamp confidence to 0..100 and derive `needs_verification` from it."""
    clamped = scoring.clamp_confidence(F.col(confidence))
    if confidence != "confidence_score":
        findings = findings.withColumn("confidence_score", clamped).drop(confidence)
    else:
        findings = findings.withColumn("confidence_score", clamped)
    return findings.withColumn(
        "needs_verification", F.col("confidence_score") < scoring.VERIFY_BELOW)


def with_reject_reason(findings: DataFrame) -> DataFrame:
    """Add `reject_reason`: the first required field that is missing or off its domain."""
    reason = None
    for name in FINDING_COLUMNS:
        if name in findings.columns:
            reason = (F if reason is None else reason).when(
                F.col(name).isNull(), F.lit(f"{name} is missing"))
    reason = (
        reason.when(~F.col("issue_category").isin(*CATEGORIES), F.lit("unknown issue_category"))
        .when(~F.col("severity").isin(*SEVERITIES), F.lit("unknown severity"))
    )
    return findings.withColumn("reject_reason", reason)


def validate_findings(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with `reject_reason`)."""
    checked = with_reject_reason(findings)
    return (
        checked.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
        checked.filter(F.col("reject_reason").isNotNull()),
    )


def finding_key(path: str = "file_path", function: str = "function_name",
                line: str = "line_number") -> Column:
    return F.concat_ws("_", F.col(path), F.col(function), F.col(line).cast("string"))


def findings_struct() -> Column:
    return F.struct(*FINDING_COLUMNS)


def filter_findings(findings: DataFrame, severities: Sequence[str] = SEVERITIES,
                    categories: Sequence[str] = CATEGORIES, show_low: bool = True) -> DataFrame:
    kept = findings.filter(
        F.col("severity").isin(*severities) & F.col("issue_category").isin(*categories))
    return kept if show_low else kept.filter(~F.col("needs_verification"))


def bucket(findings: DataFrame) -> DataFrame:
    """Add `bucket`: needs_verification or high_confidence."""
    return findings.withColumn("bucket", F.when(
        F.col("needs_verification"), "needs_verification").otherwise("high_confidence"))


def high_priority(findings: DataFrame) -> DataFrame:
    return findings.filter(scoring.is_high_priority(F.col("severity")))


def kpis(findings: DataFrame, by: Sequence[str] = (), rounding: str = "half_even") -> DataFrame:
    """Total, critical, high, high priority, to verify and average confidence (0 if empty)."""
    severity = F.col("severity")
    mean = F.coalesce(F.avg("confidence_score"), F.lit(0.0))
    return findings.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(severity == "Critical").alias("critical"),
        F.count_if(severity == "High").alias("high"),
        F.count_if(scoring.is_high_priority(severity)).alias("high_priority"),
        F.count_if("needs_verification").alias("verify"),
        scoring.percent_text(mean, rounding).alias("avg_confidence"),
    )


def _top(counted: DataFrame, by: Sequence[str], order: list[Column], k: int) -> DataFrame:
    if not by:
        return counted.orderBy(*order).limit(k)
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return counted.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def top_files(findings: DataFrame, k: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Files with most findings; equal counts by path."""
    counted = findings.groupBy(*by, "file_path").agg(F.count("*").alias("count"))
    return _top(counted, by, [F.desc("count"), F.asc("file_path")], k)


def top_basenames(findings: DataFrame, k: int = 8, by: Sequence[str] = ()) -> DataFrame:
    """File names (folders merged) with most findings; equal counts by first appearance."""
    counted = findings.groupBy(*by, base_name(F.col("file_path")).alias("file")).agg(
        F.count("*").alias("count"), F.min("idx").alias("first_idx"))
    return _top(counted, by, [F.desc("count"), F.asc("first_idx")], k)


def severity_counts(findings: DataFrame, by: Sequence[str] = (),
                    zero_fill: bool = False) -> DataFrame:
    """Findings per severity. `zero_fill` lists all four, worst first, absent ones as 0."""
    if not zero_fill:
        return findings.groupBy(*by, "severity").agg(F.count("*").alias("count"))
    counts = findings.groupBy(*by).agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    return counts.select(*by, F.posexplode(F.array(*[
        F.struct(F.lit(s).alias("severity"), F.col(s).alias("count")) for s in SEVERITIES
    ])).alias("position", "_row")).select(*by, "position", "_row.severity", "_row.count")


def bucket_totals(findings: DataFrame, by: Sequence[str] = (), **filters) -> DataFrame:
    """All findings, and of those left by `filters` the actionable and the flagged ones."""
    kept = F.col("severity").isin(*filters.get("severities", SEVERITIES)) & F.col(
        "issue_category").isin(*filters.get("categories", CATEGORIES))
    flagged = F.col("needs_verification")
    shown = kept & flagged if filters.get("show_low", True) else F.lit(False)
    return findings.groupBy(*by).agg(
        F.count("*").alias("findings"),
        F.count_if(kept & ~flagged).alias("actionable"),
        F.count_if(shown).alias("flagged"),
    )


def with_finding_index(findings: DataFrame, pos: str = "pos") -> DataFrame:
    """Add `idx`: 0-based position in the repo, by batch, then by place in the report."""
    return number_rows(findings, ["repo"], ["batch_id"], pos, "idx")


def by_function(findings: DataFrame, keys: Sequence[str] = ("repo", "function_name")) -> DataFrame:
    """Per function: number of findings, worst severity rank, distinct weakness classes."""
    return with_cwe(findings).groupBy(*keys).agg(
        F.count("*").alias("findings"),
        F.min(scoring.severity_rank(F.col("severity"))).alias("worst_rank"),
        F.array_sort(F.collect_set("cwe_id")).alias("cwe_ids"),
    )


def function_findings(findings: DataFrame, keys: Sequence[str] = ("repo", "function_name"),
                      page: int = LIST_PAGE) -> DataFrame:
    """Findings of each function as ordered lists.

    A function may have any number of findings, so its list comes in pages by `idx`
    (`idx div page`): every list is bounded and every finding is in exactly one.
    """
    return findings.groupBy(*keys, F.expr(f"idx div {page}").alias("page")).agg(
        F.sort_array(F.collect_list(F.struct("idx", *FINDING_COLUMNS))).alias("findings"))


def sort_by_severity(findings: DataFrame) -> DataFrame:
    """Worst first; within a severity in finding order."""
    return findings.orderBy(scoring.severity_rank(F.col("severity")), "idx")
