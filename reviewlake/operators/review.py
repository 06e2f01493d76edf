"""Review of blocks: a rule reviewer on native expressions, and pluggable reviewers per batch."""

from __future__ import annotations

import json
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from functools import reduce
from operator import or_
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import each_row
from ..functions.secrets import scrub
from ..schemas import FINDING_COLUMNS, REPORT, REVIEWED
from ..session import materialize
from .findings import normalize_findings, with_reject_reason

PYTHON = ("python",)
SCRIPT = ("javascript", "typescript", "tsx")


class Rule(NamedTuple):
    rule: str
    languages: tuple[str, ...]
    pattern: str
    category: str
    severity: str
    confidence: int
    issue: str
    fix: str
    impact: str
    needles: tuple[str, ...]  # every match contains one of them, in lower case


RULES = (
    Rule("SQLI_PY", PYTHON,
         r"(?i)f[\"'][^\n]*\b(select|insert|update|delete)\b[^\n]*\{"
         r"|\b(select|insert|update|delete)\b[^\n]*[\"']\s*\+",
         "Security", "Critical", 95, "sql injection through a query built from text",
         "Pass values as query parameters.", "An attacker could read or change the database.",
         ("select", "insert", "update", "delete")),
    Rule("SQLI_JS", SCRIPT,
         r"(?i)`[^`]*\b(select|insert|update|delete)\b[^`]*\$\{"
         r"|\b(select|insert|update|delete)\b[^\n]*[\"']\s*\+",
         "Security", "Critical", 95, "sql injection through a query built from text",
         "Pass values as query parameters.", "An attacker could read or change the database.",
         ("select", "insert", "update", "delete")),
    Rule("XSS_PY", PYTHON,
         r"f\"[^\"\n]*<[a-zA-Z][^\"\n]*\{|f'[^'\n]*<[a-zA-Z][^'\n]*\{",
         "Security", "High", 85, "cross-site scripting through unescaped markup",
         "Escape values before putting them into markup.",
         "An attacker could run scripts in a visitor's browser.",
         ("<",)),
    Rule("XSS_JS", SCRIPT,
         r"\.innerHTML\s*\+?=|dangerouslySetInnerHTML|document\.write(ln)?\(",
         "Security", "High", 90, "xss through unescaped markup",
         "Set text content or sanitize the markup.",
         "An attacker could run scripts in a visitor's browser.",
         (".innerhtml", "dangerouslysetinnerhtml", "document.write")),
    Rule("CMD_PY", PYTHON, r"shell\s*=\s*True|os\.system\(",
         "Security", "Critical", 95, "command injection through a system shell",
         "Pass an argument list and no shell.",
         "An attacker could run commands on the server.",
         ("shell", "os.system(")),
    Rule("CMD_JS", SCRIPT, r"\b(child_process\.)?exec(Sync)?\(",
         "Security", "High", 60, "possible command injection",
         "Use execFile with an argument list.",
         "An attacker could run commands on the server.",
         ("exec",)),
    Rule("DESER_PY", PYTHON, r"\bpickle\.loads?\(",
         "Security", "Critical", 95, "unsafe deserialization of untrusted bytes",
         "Use a data-only format such as JSON.",
         "An attacker could run code by sending crafted data.",
         ("pickle.load",)),
    Rule("DESER_JS", SCRIPT, r"\beval\(|vm\.runInContext\(",
         "Security", "High", 85, "unsafe deserialization by running text as code",
         "Parse the data with JSON.parse.",
         "An attacker could run code by sending crafted data.",
         ("eval(", "vm.runincontext(")),
    Rule("PROTO_JS", SCRIPT, r"\b(_|lodash)\.merge\(|\w\[[A-Za-z_$][\w$]*\]\s*=[^=]",
         "Security", "Medium", 60, "possible prototype pollution",
         "Check keys against an allow list.",
         "An attacker could change the behaviour of unrelated objects.",
         (".merge(", "]")),
    Rule("DIV_PY", PYTHON, r"return\s+\w+\s*/\s*\w+",
         "Bug", "Medium", 80, "possible division by zero",
         "Test the divisor first.", "The call could crash on a zero value.",
         ("return",)),
)


_MARK = "\x01"


def review_rules(blocks: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of all matches of all rules in each block, on scrubbed code.

    A rule gives one finding per line. A definition inside another repeats the same text, so a hit
    is kept once, for the definition that starts last. Blocks without a hit leave before anything
    is cut or moved, and code itself is never shuffled. A regular expression runs only on code of
    its language that contains one of its needles.
    """
    carried = ["repo", "file_path", "name", "line_number", "ord"]
    carried += ["batch_id"] if "batch_id" in blocks.columns else []
    return hit_findings(rule_hits(blocks, carried, rules), rules)


def rule_hits(blocks: DataFrame, carried: Sequence[str], rules: tuple[Rule, ...] = RULES,
              outer: bool = False) -> DataFrame:
    """A row per rule and line with a match: the columns `carried` and _rule, _line, _snippet.

    A match belongs to the line it starts on; many matches on a line are one row, so rows never hold
    more text than the code itself. With `outer`, blocks without a match keep one row, with
    nulls, and `_first` marks one row of every block: the table then stands for the blocks as well,
    without their code.
    """
    explode = F.posexplode_outer if outer else F.posexplode
    clean = scrub(blocks).withColumn("_lowered", F.lower("code"))
    hit = [
        F.when(
            F.col("language").isin(*r.languages)
            & reduce(or_, [F.col("_lowered").contains(n) for n in r.needles])
            & F.col("code").rlike(r.pattern),
            F.lit(i))
        for i, r in enumerate(rules)
    ]
    matched = clean.select(*carried, "code",
                           explode(F.array_compact(F.array(*hit))).alias("_nth", "_rule"))
    marked = None
    for i, r in enumerate(rules):
        here = F.col("_rule") == i
        marked = (F if marked is None else marked).when(
            here, F.regexp_replace("code", r.pattern, _MARK + "$0"))
    # a line that a mark has made longer holds the start of a match
    lines = F.zip_with(F.split("code", "\n", -1), F.split(marked, "\n", -1),
                       lambda line, other: F.when(F.length(other) > F.length(line), line))
    found = F.filter(
        F.transform(lines, lambda line, i: F.struct(i.alias("at"), line.alias("text"))),
        lambda x: x["text"].isNotNull())
    placed = matched.select(*carried, "_nth", "_rule", explode(found).alias("_mth", "_hit"))
    first = (F.coalesce("_nth", F.lit(0)) == 0) & (F.coalesce("_mth", F.lit(0)) == 0)
    return placed.select(
        *carried, "_rule", *([first.alias("_first")] if outer else []),
        (F.col("line_number") + F.col("_hit.at")).cast("int").alias("_line"),
        F.col("_hit.text").alias("_snippet"))


def hit_findings(placed: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of the rows of `rule_hits`, each kept once, for the innermost definition."""
    carried = [c for c in ("name", "ord", "batch_id", "_snippet") if c in placed.columns]
    innermost = F.max_by(F.struct(*carried), F.struct("line_number", "ord")).alias("_block")
    kept = placed.where(F.col("_rule").isNotNull()).groupBy(
        "repo", "file_path", "_rule", "_line").agg(innermost)

    def per_rule(value: Callable[[Rule], Any]):
        return F.get(F.array(*[F.lit(value(r)) for r in rules]), F.col("_rule"))

    name = F.col("_block.name")
    found = kept.select(
        "repo",
        *([F.col("_block.batch_id").alias("batch_id")] if "batch_id" in carried else []),
        F.col("_block.ord").alias("block_ord"),
        per_rule(lambda r: r.rule).alias("rule"),
        "file_path",
        name.alias("function_name"),
        F.col("_line").alias("line_number"),
        per_rule(lambda r: r.category).alias("issue_category"),
        per_rule(lambda r: r.severity).alias("severity"),
        F.concat(name, F.lit(": "), per_rule(lambda r: r.issue)).alias("comment"),
        per_rule(lambda r: r.fix).alias("suggested_fix"),
        F.trim("_block._snippet").alias("vulnerable_snippet"),
        per_rule(lambda r: r.impact).alias("impact"),
        per_rule(lambda r: r.confidence).alias("confidence_score"),
    )
    return normalize_findings(found)


class RetryableError(Exception):
    """Raised by a reviewer for a failure worth trying again, such as a rate limit."""


Reviewer = Callable[[str, int, str], dict[str, Any]]
_REPORTS = 500  # handed on at once
_REPORT_CHARS = 4 << 20  # and their characters


class Throttle:
    """At most `per_second` calls a second on average, with bursts of up to a second's worth."""

    def __init__(self, per_second: float):
        self.per_second, self.lock = per_second, threading.Lock()
        self.tokens, self.at = max(1.0, per_second), time.monotonic()

    def take(self) -> None:
        """Wait for a turn. Callers get theirs in the order they ask."""
        with self.lock:
            now = time.monotonic()
            self.tokens = min(max(1.0, self.per_second),
                              self.tokens + (now - self.at) * self.per_second)
            self.at = now
            self.tokens -= 1
            wait = -self.tokens / self.per_second
        if wait > 0:
            time.sleep(wait)


def _in_order(rows: Iterator[Any], call: Callable[[Any], Any], in_flight: int) -> Iterator[Any]:
    """Results of `call` in the order of `rows`, with up to `in_flight` calls at a time."""
    with ThreadPoolExecutor(in_flight) as pool:
        waiting: deque[Future] = deque()
        for row in rows:
            waiting.append(pool.submit(call, row))
            if len(waiting) >= 2 * in_flight or waiting[0].done():
                yield waiting.popleft().result()
        while waiting:
            yield waiting.popleft().result()


def review_batches(prompts: DataFrame, reviewer: Reviewer, attempts: int = 3,
                   wait_seconds: float = 5.0, in_flight: int = 1,
                   calls_per_second: float | None = None) -> DataFrame:
    """(repo, batch_id, prompt) to (repo, batch_id, report, error).

    `reviewer(repo, batch_id, prompt)` returns a report: {"reviews": [...], "batch_summary":
    ...}. Batches run in parallel, `in_flight` at a time in every task, where a reviewer that waits
    for a service leaves the core to others; then it must be safe to call from several threads.
    `calls_per_second` bounds the calls of a task, repeated ones included; results keep the order
    of the batches. A failed batch becomes a row with `error` and costs only itself; a
    RetryableError is tried again after 1, 2, 4... times `wait_seconds`.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        throttle = Throttle(calls_per_second) if calls_per_second else None

        def one(row: tuple[str, int, str]) -> tuple[str, int, str | None, str | None]:
            repo, batch_id, prompt = row
            for attempt in range(attempts):
                try:
                    if throttle:
                        throttle.take()
                    return repo, batch_id, json.dumps(reviewer(repo, batch_id, prompt)), None
                except RetryableError:
                    if attempt + 1 < attempts:
                        time.sleep(wait_seconds * 2**attempt)
                except Exception as e:  # a failed batch costs only itself
                    return repo, batch_id, None, f"{type(e).__name__}: {e}"
            return repo, batch_id, None, f"gave up after {attempts} attempts"

        rows = (tuple(row.values()) for row in each_row(batches))
        held, size = [], 0
        for row in _in_order(rows, one, in_flight):
            held.append(row)
            size += len(row[2] or "")
            if len(held) >= _REPORTS or size > _REPORT_CHARS:
                yield _reports(held)
                held, size = [], 0
        if held:
            yield _reports(held)

    return prompts.select("repo", F.col("batch_id").cast("long"), "prompt").mapInArrow(
        run, REVIEWED)


def _reports(rows: list[tuple]) -> pa.RecordBatch:
    repos, ids, reports, errors = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(repos, pa.string()), pa.array(ids, pa.int64()), pa.array(reports, pa.string()),
         pa.array(errors, pa.string())], names=["repo", "batch_id", "report", "error"])


def read_reports(reviewed: DataFrame, json_col: str = "report") -> DataFrame:
    """Report JSON to one row per finding, normalized, with its place `pos` in the report.

    `reject_reason` is set for a finding with a missing or off-domain field, and for a report
    that is no valid JSON, which gives one row without a finding. A valid report without
    findings also gives one such row, so that its summary is kept.
    """
    keys = [c for c in ("repo", "batch_id") if c in reviewed.columns]
    schema = T.StructType([*REPORT.fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json(json_col, schema, {"columnNameOfCorruptRecord": "_corrupt"})
    # The generator keeps the parse a column: projected directly, it would run once per use.
    reports = reviewed.filter(F.col(json_col).isNotNull()).select(
        *keys, F.explode_outer(F.array(parsed)).alias("_r"))
    rows = reports.select(
        *keys, F.col("_r.batch_summary").alias("batch_summary"),
        F.col("_r._corrupt").isNotNull().alias("_corrupt"),
        F.posexplode_outer(F.when(F.col("_r._corrupt").isNull(), F.col("_r.reviews")))
        .alias("pos", "_f"))
    flat = with_reject_reason(
        normalize_findings(rows.select(*keys, "batch_summary", "_corrupt", "pos", "_f.*")))
    reason = F.when(F.col("_corrupt"), "malformed report").when(
        F.col("pos").isNotNull(), F.col("reject_reason"))
    return flat.withColumn("reject_reason", reason).drop("_corrupt")


def parse_reports(reviewed: DataFrame, json_col: str = "report") \
        -> tuple[DataFrame, DataFrame, DataFrame]:
    """Report JSON to (findings with `pos`, summaries, rejects with `reason`).

    Reports are parsed once, into a table that the three share; a reviewer that `reviewed` still
    has to call is called once.
    """
    rows = materialize(read_reports(reviewed, json_col), "parsed-reports")
    keys = [c for c in ("repo", "batch_id") if c in reviewed.columns]
    valid, reason = F.col("reject_reason").isNull(), F.col("reject_reason")
    findings = rows.filter(valid & F.col("pos").isNotNull()).select(*keys, "pos", *FINDING_COLUMNS)
    malformed = F.coalesce(reason == "malformed report", F.lit(False))
    summaries = rows.filter(~malformed & F.coalesce(F.col("pos") == 0, F.lit(True))).select(
        *keys, "batch_summary")
    return findings, summaries, rows.filter(~valid).select(*keys, "pos", reason.alias("reason"))


def batch_errors(reviewed: DataFrame) -> DataFrame:
    return reviewed.filter(F.col("error").isNotNull()).select("repo", "batch_id", "error")


def pending(prompts: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Batches without a report yet: never tried, or failed."""
    done = reviewed.filter(F.col("error").isNull()).select("repo", "batch_id")
    return prompts.join(done, ["repo", "batch_id"], "left_anti")


def review_progress(batches: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Per repo: batches done, batches in all and their ratio, kept within 0..1."""
    total = batches.select("repo", "batch_id").distinct().groupBy("repo").agg(
        F.count("*").alias("total"))
    done = reviewed.filter(F.col("error").isNull()).select("repo", "batch_id").distinct() \
        .groupBy("repo").agg(F.count("*").alias("done"))
    ratio = F.coalesce(F.try_divide(F.col("done"), F.col("total")), F.lit(0.0))
    return total.join(done, "repo", "left").select(
        "repo", F.coalesce("done", F.lit(0)).alias("done"), "total",
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)).alias("ratio"))
