"""Hot keys: results stay whole, and the plans keep hot groups out of single tasks."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewlake.operators import (
    call_graph, findings, health, history, positions, pull_requests)
from reviewlake.sinks import reports
from sessions import conf


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_positions_across_slices_equal_a_window(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("repo"),
        F.concat(F.lit("f"), F.col("id") % 997).alias("unit"), F.hash("id").alias("at"))
    with conf(spark, spark__sql__adaptive__coalescePartitions__enabled=False,
              spark__sql__shuffle__partitions=7):
        got = positions.number_rows(df, ["repo"], ["unit"], "at", "n").collect()
    wanted = df.withColumn("n", F.row_number().over(
        W.partitionBy("repo").orderBy("unit", "at")) - 1)
    assert sorted((r.repo, r.unit, r["at"], r.n) for r in got) == sorted(
        (r.repo, r.unit, r["at"], r.n) for r in wanted.collect())


def test_the_hot_group_spans_slices(spark):
    df = spark.range(5000).select(F.lit("hot").alias("repo"), "id", F.lit(1).alias("one"))
    with conf(spark, spark__sql__adaptive__coalescePartitions__enabled=False,
              spark__sql__shuffle__partitions=5):
        offsets = positions.running_offset(df, ["repo"], ["id"], "one", "n")
        assert offsets.filter("n <> id").count() == 0 and offsets.count() == 5000
    slices = [n for n in offsets.inputFiles()]
    assert len(slices) == 5


def calls_with_hot_callee(spark, n: int = 3000):
    return spark.range(n).select(
        F.lit("r").alias("repo"), F.lit("a.py").alias("path"), F.col("id").cast("int").alias("ord"),
        F.concat(F.lit("f"), "id").alias("caller"), F.array(F.lit("print")).alias("callees"))


def test_callers_of_a_hot_name_are_cut_before_the_shuffle(spark):
    calls = calls_with_hot_callee(spark)
    found = call_graph.callers(call_graph.latest_calls(calls))
    assert found.first().callers == [f"f{i}" for i in range(5)]
    plan = plan_of(found)
    assert "Partial" in plan.split("WindowGroupLimit", 1)[1]


def test_ranked_reports_are_cut_before_the_shuffle(spark):
    rows = spark.range(1000).select(
        F.concat(F.lit("r"), F.col("id") % 2).alias("repo"), F.col("id").alias("idx"), F.lit("High").alias("severity"),
        F.lit("p").alias("file_path"), F.lit(1).alias("line_number"), F.lit("Bug").alias("issue_category"),
        F.lit("c").alias("comment"), F.lit("s").alias("suggested_fix"), F.lit(90).alias("confidence_score"),
        F.lit(False).alias("needs_verification"), F.current_timestamp().alias("ts"),
        F.lit(1).alias("findings"))
    files = rows.select("repo", "file_path").limit(1)
    for df in (pull_requests.plan_pr_comments(rows, files), history.recent_scans(rows, 5, ["repo"])):
        assert plan_of(df).count("WindowGroupLimit") >= 2
    assert "TakeOrderedAndProject" in plan_of(findings.top_files(rows))


@contextlib.contextmanager
def no_broadcast_and_low_skew_limits(spark):
    with conf(spark, spark__sql__autoBroadcastJoinThreshold=-1,
              spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="10KB",
              spark__sql__adaptive__skewJoin__skewedPartitionFactor=2.0,
              spark__sql__adaptive__advisoryPartitionSizeInBytes="10KB"):
        yield


def is_split(df) -> bool:
    df.collect()
    return "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def hot(spark, n: int = 60_000):
    """Two thirds of the rows under one key, the others under many."""
    key = F.when(F.col("id") % 3 > 0, "f0").otherwise(F.concat(F.lit("f"), "id"))
    return spark.range(n).select(
        F.concat(F.lit("r"), F.col("id") % 1).alias("repo"), "id", key.alias("name"),
        F.sha2(F.col("id").cast("string"), 512).alias("code"))


def test_a_hot_name_is_split_in_the_context_join(spark):
    graph = call_graph.latest_calls(calls_with_hot_callee(spark))
    with no_broadcast_and_low_skew_limits(spark):
        joined = call_graph.with_call_context(hot(spark), graph)
        assert is_split(joined) and joined.count() == 60_000


def test_a_hot_finding_key_is_split_in_the_feedback_join(spark):
    rows = hot(spark).withColumns({"file_path": F.col("name"), "function_name": F.lit("g"),
                                   "line_number": F.lit(1)})
    feedback = spark.range(600).select(
        F.lit("r0").alias("repo"), F.concat(F.lit("f"), F.col("id"), F.lit("_g_1")).alias("finding_key"),
        F.lit("false_positive").alias("verdict"), F.col("id").alias("ts"))
    with no_broadcast_and_low_skew_limits(spark):
        left = health.drop_false_positives(rows, health.latest_feedback(feedback))
        assert is_split(left) and left.count() == 20_000 - 200


def test_a_hot_repo_is_split_in_the_responses(spark):
    texts = {n: F.col("code") for n in ("file_path", "function_name", "issue_category", "severity",
                                        "comment", "suggested_fix", "vulnerable_snippet", "impact")}
    rows = hot(spark).withColumns({
        "repo": F.col("name"), "idx": F.col("id"), "line_number": F.lit(1),
        "confidence_score": F.lit(1), "needs_verification": F.lit(True), **texts})
    targets = rows.select("repo", F.col("repo").alias("repo_url")).distinct()
    with no_broadcast_and_low_skew_limits(spark):
        assert is_split(reports.scan_responses(targets, rows, page=10))


def test_function_lists_are_bounded_and_whole(spark):
    names = ("file_path", "issue_category", "severity", "comment", "suggested_fix",
             "vulnerable_snippet", "impact")
    rows = spark.range(2500).select(
        F.lit("r").alias("repo"), F.col("id").alias("idx"), F.lit("hot").alias("function_name"),
        *[F.lit("x").alias(n) for n in names], F.lit(1).alias("line_number"),
        F.lit(1).alias("confidence_score"), F.lit(True).alias("needs_verification"))
    pages = findings.function_findings(rows, page=1000).collect()
    assert sorted(len(p.findings) for p in pages) == [500, 1000, 1000]


def test_filters_and_columns_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select(
        F.concat(F.lit("r"), "o_custkey").alias("repo"), F.col("o_orderstatus").alias("severity"),
        F.col("o_orderpriority").alias("issue_category"), F.lit(False).alias("needs_verification"))
    kept = findings.filter_findings(df, severities=["O", "F"], categories=["1-URGENT"])
    plan = plan_of(kept.select("repo"))
    assert "In(o_orderstatus, [O,F])" in plan or "In(o_orderstatus, [F,O])" in plan
    assert "struct<o_custkey:bigint,o_orderstatus:string,o_orderpriority:string>" in plan
