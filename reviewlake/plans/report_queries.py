"""Queries over findings, history, metadata and addresses."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cwe, scoring
from ..functions.text import has_text
from ..operators import findings as fo
from ..operators import health as ho
from ..operators import history as hist
from ..operators import keywords
from ..operators import pull_requests as pr
from ..operators.review import parse_reports
from ..schemas import FINDING_COLUMNS, FINDING_FIELDS
from ..session import fresh_path
from ..sinks import reports
from ..sinks.feedback import append_feedback, compact, read_feedback
from ..sources.repo_meta import parse_repo_meta
from ..sources.targets import check_targets, validate_targets
from ..streaming.health import (
    EVENTS, finding_events, health_stream, running_health, verdict_events)
from .inputs import read, values
from .registry import query

_PIECE = 8 << 20  # bytes of a file that are read at once


def findings(spark: SparkSession, sf: str) -> DataFrame:
    return fo.normalize_findings(read(spark, sf, "raw_findings_v"), "raw_confidence")


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    return ho.latest_feedback(read(spark, sf, "feedback_v"), ("n", "idx"))


_WEIGHT = "CASE severity WHEN 'Critical' THEN 25 WHEN 'High' THEN 10 WHEN 'Medium' THEN 4 ELSE 1 END"
_RANK = "CASE severity WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END"
_KEY = "concat_ws('_', file_path, function_name, CAST(line_number AS STRING))"
_LATEST = """SELECT repo, finding_key, arg_max(verdict, n * 1000000000 + idx) AS verdict
    FROM feedback_v GROUP BY repo, finding_key"""
_CWE_NUMBER = "CASE " + " ".join(
    f"WHEN contains(lower(comment), '{k}') THEN {n}" for k, n in cwe.CWE_KEYWORDS) + " END"


@query("normalize_findings", """
    SELECT idx, repo, confidence_score, needs_verification FROM findings_v""")
def _(spark, sf):
    return findings(spark, sf).select("idx", "repo", "confidence_score", "needs_verification")


@query("finding_columns", f"""
    SELECT idx, {_KEY} AS finding_key, {_WEIGHT} AS weight, {_RANK} AS rank,
      CASE WHEN confidence_score >= 80 THEN '#22C55E' WHEN confidence_score >= 60 THEN '#F5A623'
        ELSE '#EF4444' END AS band, trim(impact) <> '' AS has_impact,
      string_split(file_path, '/')[-1] AS file FROM findings_v""")
def _(spark, sf):
    severity = F.col("severity")
    return findings(spark, sf).select(
        "idx", fo.finding_key().alias("finding_key"),
        scoring.severity_weight(severity).alias("weight"),
        scoring.severity_rank(severity).alias("rank"),
        scoring.confidence_band(F.col("confidence_score")).alias("band"),
        has_text(F.col("impact")).alias("has_impact"),
        F.substring_index("file_path", "/", -1).alias("file"))


_OFF_DOMAIN = """SELECT * REPLACE (
    CASE WHEN idx % 11 = 0 THEN 'Other' WHEN idx % 17 = 0 THEN NULL ELSE issue_category END
      AS issue_category,
    CASE WHEN idx % 13 = 0 THEN 'Severe' WHEN idx % 19 = 0 THEN NULL ELSE severity END
      AS severity) FROM findings_v"""


@query("validate_findings", f"""
    SELECT idx, CASE WHEN issue_category IS NULL THEN 'issue_category is missing'
        WHEN severity IS NULL THEN 'severity is missing'
        WHEN issue_category = 'Other' THEN 'unknown issue_category'
        WHEN severity = 'Severe' THEN 'unknown severity' END AS reject_reason
    FROM ({_OFF_DOMAIN}) f""")
def _(spark, sf):
    i = F.col("idx")
    category = F.when(i % 11 == 0, "Other").when(i % 17 == 0, None).otherwise(
        F.col("issue_category"))
    severity = F.when(i % 13 == 0, "Severe").when(i % 19 == 0, None).otherwise(F.col("severity"))
    altered = findings(spark, sf).withColumns({"issue_category": category, "severity": severity})
    accepted, rejected = fo.validate_findings(altered)
    none = accepted.withColumn("reject_reason", F.lit(None).cast("string"))
    return none.unionByName(rejected).select("idx", "reject_reason")


@query("filter_findings", """
    SELECT idx, repo, severity, issue_category FROM findings_v
    WHERE severity IN ('Critical', 'High') AND issue_category IN ('Security', 'Bug', 'Style')
      AND NOT needs_verification""")
def _(spark, sf):
    kept = fo.filter_findings(findings(spark, sf), ["Critical", "High"],
                              ["Security", "Bug", "Style"], show_low=False)
    return kept.select("idx", "repo", "severity", "issue_category")


@query("finding_buckets", """
    SELECT idx, CASE WHEN needs_verification THEN 'needs_verification' ELSE 'high_confidence' END
      AS bucket FROM findings_v""")
def _(spark, sf):
    return fo.bucket(findings(spark, sf)).select("idx", "bucket")


@query("high_priority", """
    SELECT idx, repo, severity FROM findings_v WHERE severity IN ('Critical', 'High')""")
def _(spark, sf):
    return fo.high_priority(findings(spark, sf)).select("idx", "repo", "severity")


def _kpi_sql(rounded: str, by: str = "") -> str:
    return f"""SELECT {by + "," if by else ""} count(*) AS total,
      count(*) FILTER (severity = 'Critical') AS critical,
      count(*) FILTER (severity = 'High') AS high,
      count(*) FILTER (severity IN ('Critical', 'High')) AS high_priority,
      count(*) FILTER (needs_verification) AS verify,
      concat(CAST({rounded} AS BIGINT), '%') AS avg_confidence
    FROM findings_v {"GROUP BY " + by if by else ""}"""


@query("kpis", _kpi_sql("round_even(avg(confidence_score), 0)"))
def _(spark, sf):
    return fo.kpis(findings(spark, sf))


@query("kpis_by_repo", _kpi_sql("round_even(avg(confidence_score), 0)", "repo"))
def _(spark, sf):
    return fo.kpis(findings(spark, sf), ["repo"])


@query("kpis_web", _kpi_sql("floor(avg(confidence_score) + 0.5)", "repo"))
def _(spark, sf):
    return fo.kpis(findings(spark, sf), ["repo"], rounding="half_up")


@query("top_files", """
    SELECT file_path, count(*) AS count FROM findings_v GROUP BY file_path
    ORDER BY count DESC, file_path LIMIT 10""")
def _(spark, sf):
    return fo.top_files(findings(spark, sf))


@query("top_files_by_repo", """
    SELECT repo, file_path, count FROM (
      SELECT repo, file_path, count(*) AS count,
        row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, file_path) AS r
      FROM findings_v GROUP BY repo, file_path) WHERE r <= 10""")
def _(spark, sf):
    return fo.top_files(findings(spark, sf), by=["repo"])


@query("top_basenames", """
    SELECT string_split(file_path, '/')[-1] AS file, count(*) AS count, min(idx) AS first_idx
    FROM findings_v GROUP BY 1 ORDER BY count DESC, first_idx LIMIT 8""")
def _(spark, sf):
    return fo.top_basenames(findings(spark, sf))


@query("top_basenames_by_repo", """
    SELECT repo, file, count, first_idx FROM (
      SELECT repo, string_split(file_path, '/')[-1] AS file, count(*) AS count,
        min(idx) AS first_idx,
        row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, min(idx)) AS r
      FROM findings_v GROUP BY 1, 2) WHERE r <= 8""")
def _(spark, sf):
    return fo.top_basenames(findings(spark, sf), by=["repo"])


@query("severity_counts", "SELECT severity, count(*) AS count FROM findings_v GROUP BY severity")
def _(spark, sf):
    return fo.severity_counts(findings(spark, sf))


@query("severity_counts_filled", f"""
    SELECT repo, d.position, d.severity, count(f.idx) AS count
    FROM (SELECT DISTINCT repo FROM findings_v) r
    CROSS JOIN ({values([(i, s) for i, s in enumerate(("Critical", "High", "Medium", "Low"))],
                        "position, severity")}) d
    LEFT JOIN findings_v f USING (repo, severity) GROUP BY 1, 2, 3""")
def _(spark, sf):
    return fo.severity_counts(findings(spark, sf), ["repo"], zero_fill=True)


def _health_sql(source: str, graded: str, kept: str = "TRUE") -> str:
    return f"""SELECT repo, CAST(round_even(raw, 0) AS BIGINT) AS score,
      CASE WHEN g >= 90 THEN 'A' WHEN g >= 75 THEN 'B' WHEN g >= 60 THEN 'C' WHEN g >= 40 THEN 'D'
        ELSE 'F' END AS grade,
      CASE WHEN g >= 90 THEN '#22C55E' WHEN g >= 75 THEN '#84CC16' WHEN g >= 60 THEN '#F5A623'
        WHEN g >= 40 THEN '#F97316' ELSE '#EF4444' END AS color
    FROM (SELECT repo, raw, {graded} AS g FROM (
      SELECT repo, (10000 - least(10000,
        coalesce(sum({_WEIGHT} * confidence_score) FILTER ({kept}), 0))) / 100 AS raw
      FROM {source} GROUP BY repo) s) t"""


@query("health_by_repo", _health_sql("findings_v", "raw"))
def _(spark, sf):
    return ho.health(findings(spark, sf))


@query("health_rounded_grade", _health_sql("findings_v", "round_even(raw, 0)"))
def _(spark, sf):
    return ho.health(findings(spark, sf), grade_on="rounded")


def _feedback_health_sql(repo: str = "repo") -> str:
    return _health_sql(f"""
    (SELECT f.*, l.verdict FROM (
       SELECT * REPLACE ({repo} AS repo), {_KEY} AS finding_key FROM findings_v) f
     LEFT JOIN (SELECT repo, finding_key, arg_max(verdict, n * 1000000000 + idx) AS verdict
       FROM (SELECT * REPLACE ({repo} AS repo) FROM feedback_v) v GROUP BY repo, finding_key) l
     USING (repo, finding_key)) j""", "raw", "verdict IS NULL OR verdict <> 'false_positive'")


@query("health_with_feedback", _feedback_health_sql())
def _(spark, sf):
    return ho.health(findings(spark, sf), feedback(spark, sf))


_ORG = "concat('org_', CAST(substr(repo, 6) AS BIGINT) % 25)"


@query("running_health", _feedback_health_sql(_ORG))
def _(spark, sf):
    """Health of groups of repositories, from findings and verdicts in several micro-batches."""
    source, out = fresh_path(spark, "events"), fresh_path(spark, "health")
    verdicts = read(spark, sf, "feedback_v").withColumn("at", F.expr("n * 1000000000 + idx"))
    events = finding_events(findings(spark, sf)).unionByName(verdict_events(verdicts, "at"))
    events.withColumn("repo", F.expr(_ORG)).repartition(4, "finding_key", "at").write.parquet(source)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 2).parquet(source)
    health_stream(spark, stream, out, f"{out}-checkpoint").awaitTermination()
    return running_health(spark, out)


@query("feedback_table", _LATEST)
def _(spark, sf):
    """Verdicts that came in four batches, one of them twice, folded after the second."""
    path, order = fresh_path(spark, "feedback"), ("n", "idx")
    given = read(spark, sf, "feedback_v")
    for batch in (0, 1, 2, 3, 3):
        append_feedback(given.where(F.pmod(F.col("idx") + F.col("n"), F.lit(4)) == batch), path,
                        str(batch), order)
        if batch == 1:
            compact(spark, path, order)
    return read_feedback(spark, path, order)


@query("latest_feedback", _LATEST)
def _(spark, sf):
    return feedback(spark, sf)


@query("without_false_positives", f"""
    SELECT idx, repo, {_KEY} AS finding_key FROM findings_v
    WHERE (repo, {_KEY}) NOT IN (SELECT (repo, finding_key) FROM ({_LATEST}) l
      WHERE verdict = 'false_positive')""")
def _(spark, sf):
    return ho.drop_false_positives(findings(spark, sf), feedback(spark, sf)).select(
        "idx", "repo", "finding_key")


@query("classify_cwe", f"""
    SELECT idx, comment, 'CWE-' || n AS cwe_id,
      'https://cwe.mitre.org/data/definitions/' || n || '.html' AS cwe_url
    FROM (SELECT idx, comment, {_CWE_NUMBER} AS n FROM findings_v) f""")
def _(spark, sf):
    return cwe.with_cwe(findings(spark, sf)).select("idx", "comment", "cwe_id", "cwe_url")


@query("classify_cwe_table", f"""
    SELECT idx, comment, 'CWE-' || n AS cwe_id,
      'https://cwe.mitre.org/data/definitions/' || n || '.html' AS url
    FROM (SELECT idx, comment, {_CWE_NUMBER} AS n FROM findings_v) c""")
def _(spark, sf):
    """The same classes, from the dictionary as a table."""
    found = keywords.with_dictionary(findings(spark, sf), cwe.cwe_keywords(spark))
    return found.select("idx", "comment", "cwe_id", "url")


@query("classify_words", """
    WITH k AS (
      SELECT DISTINCT unnest(string_split(lower(regexp_replace(text, '[.,;:!?]', '', 'g')), ' '))
        AS keyword FROM benchmark)
    SELECT conv_id, turn, min(keyword) AS keyword
    FROM conversations c LEFT JOIN k ON length(keyword) > 2 AND contains(lower(text), keyword)
    GROUP BY conv_id, turn""")
def _(spark, sf):
    """The first of thousands of words, in alphabetical order, that each turn contains."""
    plain = F.lower(F.regexp_replace("text", "[.,;:!?]", ""))
    words = read(spark, sf, "benchmark").select(F.explode(F.split(plain, " ")).alias("keyword"))
    words = words.where(F.length("keyword") > 2).distinct().select(
        F.col("keyword").alias("prio"), "keyword", F.col("keyword").alias("word"))
    found = keywords.with_dictionary(read(spark, sf, "conversations"), words, "text")
    return found.select("conv_id", "turn", F.col("word").alias("keyword"))


@query("cwe_keyword_usage", f"""
    WITH k AS ({values([(i, k, f"CWE-{n}", cwe.CWE_URL.format(n))
                        for i, (k, n) in enumerate(cwe.CWE_KEYWORDS)],
                       "prio, keyword, cwe_id, url")})
    SELECT k.prio, keyword, k.cwe_id, url, count(f.prio) AS findings FROM k LEFT JOIN
      (SELECT CASE {" ".join(f"WHEN contains(lower(comment), '{k}') THEN {i}"
                             for i, (k, _) in enumerate(cwe.CWE_KEYWORDS))} END AS prio
       FROM findings_v) f ON f.prio = k.prio GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    used = cwe.with_keyword(findings(spark, sf)).groupBy(
        F.col("cwe_prio").alias("prio")).agg(F.count("*").alias("findings"))
    return cwe.cwe_keywords(spark).join(used, "prio", "left").fillna(0, ["findings"])


@query("by_function", f"""
    SELECT repo, function_name, count(*) AS findings, min({_RANK}) AS worst_rank,
      coalesce((SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT DISTINCT unnest(
        list('CWE-' || n)) AS c)), '') AS cwe_ids
    FROM (SELECT *, {_CWE_NUMBER} AS n FROM findings_v) f GROUP BY repo, function_name""")
def _(spark, sf):
    return fo.by_function(findings(spark, sf)).withColumn("cwe_ids", F.array_join("cwe_ids", ","))


@query("function_findings", """
    SELECT function_name, idx // 1000 AS page, count(*) AS n,
      string_agg(CAST(idx AS STRING), ',' ORDER BY idx) AS idxs
    FROM findings_v GROUP BY 1, 2""")
def _(spark, sf):
    pages = fo.function_findings(findings(spark, sf), ["function_name"])
    listed = F.transform("findings", lambda f: f["idx"].cast("string"))
    return pages.select("function_name", "page", F.size("findings").cast("long").alias("n"),
                        F.array_join(listed, ",").alias("idxs"))


@query("bucket_totals", """
    SELECT repo, count(*) AS findings,
      count(*) FILTER (severity <> 'Low' AND NOT needs_verification) AS actionable,
      count(*) FILTER (severity <> 'Low' AND needs_verification) AS flagged
    FROM findings_v GROUP BY repo""")
def _(spark, sf):
    return fo.bucket_totals(findings(spark, sf), ["repo"],
                            severities=("Critical", "High", "Medium"))


@query("finding_index", """
    SELECT repo, idx AS pos, idx % 7 AS batch_id,
      row_number() OVER (PARTITION BY repo ORDER BY idx % 7, idx) - 1 AS idx FROM findings_v""")
def _(spark, sf):
    placed = read(spark, sf, "raw_findings_v").select(
        "repo", F.col("idx").alias("pos"), (F.col("idx") % 7).alias("batch_id"))
    return fo.with_finding_index(placed)


@query("sort_by_severity", f"SELECT idx, severity, {_RANK} AS rank FROM findings_v")
def _(spark, sf):
    rank = scoring.severity_rank(F.col("severity")).alias("rank")
    return fo.sort_by_severity(findings(spark, sf)).select("idx", "severity", rank)


_PR_PLAN = f"""SELECT f.repo, position, idx,
      CASE WHEN p.repo IS NULL THEN 'skipped' ELSE 'planned' END AS status, f.file_path AS path,
      line_number AS line, 'RIGHT' AS side, concat('**[AI Code Review] ', issue_category, ' — ',
        severity, ' Severity**', chr(10), chr(10), comment, chr(10), chr(10), '**Suggested fix:** ',
        suggested_fix, chr(10), chr(10), '*Confidence: ', confidence_score, '%',
        CASE WHEN needs_verification THEN ' — ⚠️ Verify before acting' ELSE '' END, '*') AS body
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY {_RANK}, idx) AS INT) AS position
          FROM findings_v) f
    LEFT JOIN (SELECT DISTINCT repo, file_path FROM pr_files_v) p
      ON f.repo = p.repo AND f.file_path = p.file_path WHERE position <= 10"""


def _plan(spark, sf):
    return pr.plan_pr_comments(findings(spark, sf), read(spark, sf, "pr_files_v"))


@query("pr_comment_plan", _PR_PLAN)
def _(spark, sf):
    return _plan(spark, sf).drop("commit_id")


@query("pr_comment_table", f"SELECT * FROM ({_PR_PLAN}) p WHERE status = 'planned'")
def _(spark, sf):
    path = fresh_path(spark, "pr-plan")
    reports.write_pr_plan(_plan(spark, sf), path)
    schema = ("repo string, position int, idx long, status string, path string, line int, "
              "side string, body string")
    return spark.read.schema(schema).parquet(path)


@query("pr_outcome", f"""
    SELECT repo, count(*) FILTER (status = 'planned' AND idx % 8 <> 0) AS posted,
      count(*) FILTER (status = 'skipped') AS skipped,
      count(*) FILTER (status = 'planned' AND idx % 8 = 0) AS failed
    FROM ({_PR_PLAN}) p GROUP BY repo""")
def _(spark, sf):
    failed = read(spark, sf, "raw_findings_v").filter(F.col("idx") % 8 == 0).select("repo", "idx")
    return pr.pr_outcome(_plan(spark, sf), failed)


@query("pr_files_with_findings", """
    SELECT idx, repo, file_path FROM findings_v
    WHERE (repo, file_path) IN (SELECT (repo, file_path) FROM pr_files_v)""")
def _(spark, sf):
    found = pr.findings_in_pr(findings(spark, sf), read(spark, sf, "pr_files_v"))
    return found.select("idx", "repo", "file_path")


def _trend_sql(pairs: str) -> str:
    sign = "CASE WHEN d > 0 THEN '{}' WHEN d < 0 THEN '{}' ELSE '{}' END"
    return f"""SELECT repo, findings, previous, d AS delta,
      {sign.format("improving", "degrading", "stable")} AS trend,
      {sign.format("↓", "↑", "→")} AS symbol,
      {sign.format("#22C55E", "#EF4444", "#F5A623")} AS color,
      concat(abs(d), ' findings ', CASE WHEN d > 0 THEN 'fewer' ELSE 'more' END,
        ' than last scan') AS text
    FROM (SELECT repo, findings, previous, previous - findings AS d FROM ({pairs}) p) t"""


@query("trend", _trend_sql("""
    SELECT repo, findings, previous FROM (SELECT *, lag(repo) OVER w AS before,
      lag(findings) OVER w AS previous, row_number() OVER (ORDER BY ts DESC) AS r
      FROM yearly_history_v WINDOW w AS (ORDER BY ts)) WHERE r = 1 AND before = repo"""))
def _(spark, sf):
    return hist.trend(read(spark, sf, "yearly_history_v"))


@query("trend_one_repo", _trend_sql("""
    SELECT 'r' AS repo, findings, previous FROM (SELECT findings,
      lag(findings) OVER (ORDER BY ts) AS previous, row_number() OVER (ORDER BY ts DESC) AS r
      FROM history_v) WHERE r = 1"""))
def _(spark, sf):
    return hist.trend(read(spark, sf, "history_v").withColumn("repo", F.lit("r")))


@query("trend_by_repo", _trend_sql("""
    SELECT repo, findings, previous FROM (SELECT *,
      lag(findings) OVER (PARTITION BY repo ORDER BY ts) AS previous,
      row_number() OVER (PARTITION BY repo ORDER BY ts DESC) AS r FROM history_v)
    WHERE r = 1 AND previous IS NOT NULL"""))
def _(spark, sf):
    return hist.trend(read(spark, sf, "history_v"), "repo")


_TIME = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query("recent_scans", f"""
    SELECT repo, findings, critical, {_TIME} FROM history_v ORDER BY history_v.ts DESC LIMIT 5""")
def _(spark, sf):
    return _shown(hist.recent_scans(read(spark, sf, "history_v")))


@query("recent_scans_by_repo", f"""
    SELECT repo, findings, critical, {_TIME}, recency FROM (SELECT *, CAST(row_number() OVER
      (PARTITION BY repo ORDER BY ts DESC) AS INT) AS recency FROM history_v) WHERE recency <= 10""")
def _(spark, sf):
    return _shown(hist.recent_scans(read(spark, sf, "history_v"), 10, ["repo"]))


@query("append_history", """
    SELECT repo, CAST(count(idx) AS INT) AS findings, CAST(count(idx) FILTER (
      severity = 'Critical') AS INT) AS critical, '2024-01-01 00:00:00' AS ts
    FROM targets_v LEFT JOIN findings_v USING (repo) GROUP BY repo""")
def _(spark, sf):
    path = fresh_path(spark, "history")
    when = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    reports.append_history(findings(spark, sf), path, when, scan_id="1")  # replaced by the next
    reports.append_history(findings(spark, sf), path, when, read(spark, sf, "targets_v"), "1")
    return _shown(reports.read_history(spark, path))


_SUMMARY = f"""SELECT repo, repo_url, count(idx) AS total_findings,
      CAST(round_even((10000 - least(10000, coalesce(sum({_WEIGHT} * confidence_score)
        FILTER (idx IS NOT NULL), 0))) / 100, 0) AS BIGINT) AS health_score
    FROM targets_v LEFT JOIN findings_v USING (repo) GROUP BY repo, repo_url"""


@query("scan_summary", f"SELECT * EXCLUDE (repo) FROM ({_SUMMARY}) s")
def _(spark, sf):
    return reports.scan_summary(read(spark, sf, "targets_v"), findings(spark, sf))


@query("scan_responses", f"""
    SELECT repo_url, total_findings, health_score, coalesce(page, 0) AS page,
      coalesce(list, '[]') AS findings
    FROM ({_SUMMARY}) s LEFT JOIN (SELECT repo, idx // 1000 AS page, CAST(to_json(list({{
      {", ".join(f"'{c}': {c}" for c in FINDING_COLUMNS)}}} ORDER BY idx)) AS STRING) AS list
      FROM findings_v GROUP BY 1, 2) f USING (repo)""")
def _(spark, sf):
    return reports.scan_responses(read(spark, sf, "targets_v"), findings(spark, sf))


@query("report_csv", f"SELECT {', '.join(FINDING_COLUMNS)} FROM findings_v")
def _(spark, sf):
    path = fresh_path(spark, "report-csv")
    reports.write_report_csv(findings(spark, sf), path)
    return spark.read.schema(FINDING_FIELDS).option("header", True).option("escape", '"') \
        .csv(path)


def _cell_sql(col: str) -> str:
    text = (f"CASE WHEN {col} THEN 'True' ELSE 'False' END" if col == "needs_verification"
            else f"coalesce(CAST({col} AS STRING), '')")
    return (f"CASE WHEN regexp_matches({text}, '[\",\\r\\n]') THEN '\"' || "
            f"replace({text}, '\"', '\"\"') || '\"' ELSE {text} END")


@query("report_csv_file", f"""
    SELECT CAST(octet_length(encode(text)) AS BIGINT) AS bytes, md5(text) AS digest FROM (
      SELECT '{",".join(FINDING_COLUMNS)}' || chr(10) || coalesce(string_agg(
        {" || ',' || ".join(map(_cell_sql, FINDING_COLUMNS))} || chr(10), '' ORDER BY idx), '')
        AS text FROM findings_v) t""")
def _(spark, sf):
    """The whole report as one file, byte by byte."""
    path = f"{fresh_path(spark, 'report')}.csv"
    reports.write_report_csv_file(findings(spark, sf), path, ["idx"])
    return _file_digest(spark, path)


def _file_digest(spark: SparkSession, path: str) -> DataFrame:
    """Bytes and MD5 of a file in the folder that executors share; one task goes through it in
    pieces, as the digest of a text can only be taken from front to end."""
    def digest(batches):
        for _ in batches:
            found, size = hashlib.md5(), 0
            with open(local, "rb") as f:
                while piece := f.read(_PIECE):
                    found.update(piece)
                    size += len(piece)
            yield pa.RecordBatch.from_pydict({"bytes": [size], "digest": [found.hexdigest()]})

    local = reports.local_path(path)
    return spark.range(1, numPartitions=1).mapInArrow(digest, "bytes long, digest string")


@query("web_csv", "SELECT {} AS line FROM findings_v".format(" || ',' || ".join(
    f"'\"' || replace(CAST({c} AS STRING), '\"', '\"\"') || '\"'" for c in reports.WEB_COLUMNS)))
def _(spark, sf):
    path = fresh_path(spark, "web-csv")
    reports.write_web_csv(findings(spark, sf), path)
    lines = spark.read.schema("line string").text(path)
    return lines.filter(F.col("line") != ",".join(reports.WEB_COLUMNS))


@query("web_csv_file", """
    SELECT CAST(octet_length(encode(text)) AS BIGINT) AS bytes, md5(text) AS digest FROM (
      SELECT '{}' || coalesce(chr(10) || string_agg({}, chr(10) ORDER BY idx), '') AS text
      FROM findings_v) t""".format(",".join(reports.WEB_COLUMNS), " || ',' || ".join(
    f"'\"' || replace(CAST({c} AS STRING), '\"', '\"\"') || '\"'" for c in reports.WEB_COLUMNS)))
def _(spark, sf):
    """The short report as one file, byte by byte."""
    path = f"{fresh_path(spark, 'web')}.csv"
    reports.write_web_csv_file(findings(spark, sf), path, ["idx"])
    return _file_digest(spark, path)


@query("repo_meta", """
    SELECT event_id,
      CASE WHEN NOT json_valid(json) THEN 0 ELSE coalesce(CAST(json ->> 'size' AS BIGINT), 0) END
        AS size_kb,
      CASE WHEN NOT json_valid(json) THEN 0
        ELSE coalesce(CAST(json ->> 'stargazers_count' AS BIGINT), 0) END AS stars,
      CASE WHEN NOT json_valid(json) THEN NULL WHEN json_exists(json, 'language')
        THEN json ->> 'language' ELSE 'Unknown' END AS language,
      '' AS description, 'main' AS default_branch FROM meta_v""")
def _(spark, sf):
    return parse_repo_meta(read(spark, sf, "meta_v"))


_URL = r"^https://github\.com/[a-zA-Z0-9_.-]+/[a-zA-Z0-9_.-]+(\.git)?$"
_CLEAN = "SELECT c_custkey, rtrim(trim(repo_url), '/') AS repo_url FROM targets_v"


@query("check_targets", rf"""
    SELECT c_custkey, repo_url,
      CASE WHEN ok THEN regexp_replace(replace(repo_url, 'https://github.com/', ''), '\.git$', '')
        END AS slug,
      CASE WHEN NOT ok THEN concat('Invalid GitHub URL format: ''', repo_url,
        '''. Expected format: https://github.com/owner/repository') END AS error
    FROM (SELECT *, regexp_matches(repo_url, '{_URL}') AS ok FROM ({_CLEAN}) c) t""")
def _(spark, sf):
    return check_targets(read(spark, sf, "targets_v").select("c_custkey", "repo_url"))


@query("accepted_targets", f"""
    SELECT c_custkey FROM ({_CLEAN}) c WHERE regexp_matches(repo_url, '{_URL}')""")
def _(spark, sf):
    return validate_targets(read(spark, sf, "targets_v"))[0].select("c_custkey")


# Reports: every tenth is cut off; the second finding of every fifth has an unknown severity.
_SECOND = "CASE WHEN idx % 5 = 0 THEN 'Severe' ELSE 'Low' END"


@query("report_findings", f"""
    SELECT repo, idx AS batch_id, CAST(0 AS INT) AS pos, file_path, severity, confidence_score,
      needs_verification FROM findings_v WHERE idx % 10 <> 3
    UNION ALL SELECT repo, idx, 1, file_path, 'Low', confidence_score, needs_verification
    FROM findings_v WHERE idx % 10 <> 3 AND idx % 5 <> 0""")
def _(spark, sf):
    return parse_reports(read(spark, sf, "reports_v", spread=True))[0].select(
        "repo", "batch_id", "pos", "file_path", "severity", "confidence_score",
        "needs_verification")


@query("report_summaries", """
    SELECT repo, idx AS batch_id, concat('summary ', idx) AS batch_summary FROM findings_v
    WHERE idx % 10 <> 3""")
def _(spark, sf):
    return parse_reports(read(spark, sf, "reports_v", spread=True))[1]


@query("report_rejects", """
    SELECT repo, idx AS batch_id, CAST(-1 AS INT) AS pos, 'malformed report' AS reason
    FROM findings_v WHERE idx % 10 = 3
    UNION ALL SELECT repo, idx, 1, 'unknown severity' FROM findings_v
    WHERE idx % 10 <> 3 AND idx % 5 = 0""")
def _(spark, sf):
    return parse_reports(read(spark, sf, "reports_v", spread=True))[2].fillna(-1, ["pos"])
