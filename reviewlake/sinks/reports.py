"""Findings, scan summaries and comment plans written for others to read."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators.findings import LIST_PAGE, findings_struct
from ..operators.health import penalty_hundredths, score_columns
from ..schemas import FINDING_COLUMNS, HISTORY
from ..session import materialize

# Columns of the short report.
WEB_COLUMNS = (
    "file_path", "function_name", "line_number", "issue_category", "severity", "comment",
    "suggested_fix", "confidence_score", "needs_verification",
)


def write_report_csv(findings: DataFrame, path: str, mode: str = "error") -> None:
    """All 11 columns, header, quotes only where needed; one file per partition."""
    rows = findings.select(*FINDING_COLUMNS).withColumn(
        "needs_verification", F.initcap(F.col("needs_verification").cast("string")))
    rows.write.mode(mode).option("header", True).option("escape", '"') \
        .option("emptyValue", "").option("ignoreLeadingWhiteSpace", False) \
        .option("ignoreTrailingWhiteSpace", False).csv(path)


def web_line() -> Column:
    """One line of the short report: every cell quoted, quotes doubled."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in WEB_COLUMNS]
    quoted = [F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
              for c in cells]
    return F.concat_ws(",", *quoted)


def web_csv_lines(findings: DataFrame) -> DataFrame:
    return findings.select(web_line().alias("line"))


def write_web_csv(findings: DataFrame, path: str, mode: str = "error") -> None:
    """Short report as text. The header is the first part; parts in name order are the file."""
    spark = findings.sparkSession
    header = spark.range(1, numPartitions=1).select(F.lit(",".join(WEB_COLUMNS)).alias("line"))
    header.union(web_csv_lines(findings)).write.mode(mode).text(path)


def report_line() -> Column:
    """One line of the whole report: quotes only where a cell needs them."""
    cells = []
    for c in FINDING_COLUMNS:
        text = F.col(c).cast("string")
        text = F.coalesce(F.initcap(text) if c == "needs_verification" else text, F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        cells.append(F.when(text.rlike('[",\\r\\n]'), quoted).otherwise(text))
    return F.concat_ws(",", *cells)


def write_report_csv_file(findings: DataFrame, path: str, order: Sequence[str],
                          parts: int | None = None) -> None:
    """All 11 columns as one file: the header, lines in `order`, each with a newline behind it."""
    _write_file(findings, report_line(), ",".join(FINDING_COLUMNS), "\n", path, order, parts)


def write_web_csv_file(findings: DataFrame, path: str, order: Sequence[str],
                       parts: int | None = None) -> None:
    """Short report as one file: the header, lines in `order`, no newline at the end."""
    _write_file(findings, web_line(), ",".join(WEB_COLUMNS), "", path, order, parts)


def _write_file(rows: DataFrame, line: Column, header: str, ending: str, path: str,
                order: Sequence[str], parts: int | None) -> None:
    """One file of a header, the `line` of each row in `order`, and `ending`.

    Lines are dealt out by ranges of `order` and written as a table once. The bytes of each range give
    where it begins in the file, and tasks write their ranges there, all at the same time; written
    again after a failure, the bytes are the same. The file takes its name when all are done.
    `path` is a file, or a file: URI, in a folder that every task can write to; a store
    without writes in the middle of a file has the writers of many parts.
    """
    target = local_path(path)
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    keys = [f"_k{i}" for i in range(len(order))]
    lines = rows.select(line.alias("line"), *[F.col(c).alias(k) for c, k in zip(order, keys)])
    dealt = (lines.repartitionByRange(parts, *keys) if parts else lines.repartitionByRange(*keys))
    dealt = materialize(dealt.withColumn("part", F.spark_partition_id()), "report")
    # a line takes a newline before it: the header is the first
    sizes = dealt.groupBy("part").agg(F.sum(F.octet_length("line") + 1).alias("size")).collect()
    starts, end = {}, len(header.encode())
    for part, size in sorted((r.part, r["size"]) for r in sizes):
        starts[part], end = end, end + size
    waiting = os.path.join(os.path.dirname(target), f".{uuid4().hex}")

    def write(rows: Iterator[Row]) -> None:
        file, at, held = None, 0, []
        for row in rows:
            if file is None or row.part != part:  # a task may hold several ranges
                if file is not None:
                    os.pwrite(file, b"".join(held), at)
                    held = []
                else:
                    file = os.open(waiting, os.O_WRONLY)
                part, at = row.part, starts[row.part]
            held.append(b"\n" + row.line.encode())
            if len(held) >= 1000:
                at += os.pwrite(file, b"".join(held), at)
                held = []
        if file is not None:
            os.pwrite(file, b"".join(held), at)
            os.fsync(file)
            os.close(file)

    try:
        with open(waiting, "wb") as f:
            f.write(header.encode())
            f.seek(end)
            f.write(ending.encode())
            f.truncate(end + len(ending))
        dealt.repartition(max(1, len(starts)), "part").sortWithinPartitions(
            "part", *keys).foreachPartition(write)
        os.replace(waiting, target)
    finally:
        if os.path.exists(waiting):
            os.remove(waiting)


def local_path(path: str) -> str:
    if "://" in path and not path.startswith("file:"):
        raise ValueError(f"not a folder that files can be written to in the middle: {path}")
    return os.path.abspath("/" + path.removeprefix("file:").lstrip("/")
                           if path.startswith("file:") else path)


def history_rows(findings: DataFrame, ts: Column, repos: DataFrame | None = None) -> DataFrame:
    """One scan-history row per repo; `repos` adds scanned repos without findings."""
    rows = findings.groupBy("repo").agg(
        F.count("*").alias("findings"),
        F.count_if(F.col("severity") == "Critical").alias("critical"))
    if repos is not None:
        rows = repos.select("repo").distinct().join(rows, "repo", "left").fillna(
            0, ["findings", "critical"])
    return rows.select("repo", F.col("findings").cast("int").alias("findings"),
                       F.col("critical").cast("int").alias("critical"),
                       ts.cast("timestamp").alias("ts"))


def append_history(findings: DataFrame, path: str, ts: Column | None = None,
                   repos: DataFrame | None = None, scan_id: str | None = None) -> None:
    """Add a scan to the history. A scan written again under its `scan_id` replaces itself."""
    when = F.current_timestamp() if ts is None else ts
    folder = f"{path}/scan={scan_id or uuid4().hex}"
    history_rows(findings, when, repos).write.mode("overwrite").parquet(folder)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """All scans of the history."""
    return spark.read.schema(HISTORY).parquet(f"{path}/scan=*")


def scan_summary(targets: DataFrame, findings: DataFrame) -> DataFrame:
    """targets(repo, repo_url) to (repo_url, total_findings, health_score); a repo without
    findings gets 0 and 100."""
    totals = findings.groupBy("repo").agg(
        F.count("*").alias("_total"), F.sum(penalty_hundredths()).alias("_penalty"))
    score = score_columns(F.col("_penalty"))[0]
    return targets.join(totals, "repo", "left").select(
        "repo_url", F.coalesce("_total", F.lit(0)).alias("total_findings"),
        score.alias("health_score"))


def scan_responses(targets: DataFrame, findings: DataFrame, page: int = LIST_PAGE) -> DataFrame:
    """Summaries with their findings as JSON: (repo_url, total_findings, health_score, page,
    findings).

    A repo may have any number of findings, so they come in pages by `idx`. Every repo has
    page 0, and only there an empty list is possible.
    """
    lists = findings.groupBy("repo", F.expr(f"idx div {page}").alias("page")).agg(
        F.sort_array(F.collect_list(F.struct("idx", findings_struct().alias("f"))))
        .alias("_list"))
    totals = findings.groupBy("repo").agg(
        F.count("*").alias("_total"), F.sum(penalty_hundredths()).alias("_penalty"))
    scanned = materialize(targets.join(totals, "repo", "left"), "totals")
    score = score_columns(F.col("_penalty"))[0].alias("health_score")
    clean = scanned.filter(F.col("_total").isNull()).select(
        "repo_url", F.lit(0).cast("long").alias("total_findings"), score,
        F.lit(0).cast("long").alias("page"), F.lit("[]").alias("findings"))
    # An inner join with a written table: split where one repo holds most pages.
    listed = scanned.filter(F.col("_total").isNotNull()).join(lists, "repo").select(
        "repo_url", F.col("_total").alias("total_findings"), score, "page",
        F.to_json(F.transform("_list", lambda e: e["f"])).alias("findings"))
    return listed.unionByName(clean)


def write_pr_plan(plan: DataFrame, path: str, mode: str = "error") -> None:
    """Comments to post, as a table for a client."""
    plan.filter(F.col("status") == "planned").write.mode(mode).parquet(path)
