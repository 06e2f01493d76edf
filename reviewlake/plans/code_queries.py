"""Queries over source files, blocks, calls, batches and reviews."""

from __future__ import annotations

import os
import re
from urllib.parse import urlparse

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.secrets import SECRET_PATTERNS, scrub, secret_hits
from ..functions.tokens import with_tokens
from ..operators import batching, call_graph, extract, files, prompts, recall, review
from ..session import fresh_path, materialize
from ..sources import tree_source
from ..sources.corpus import read_corpus, read_files, write_corpus
from ..sources.tree import read_tree
from ..streaming.progress import ProgressListener, repo_progress
from ..streaming.reviews import (
    observe_progress, read_reviewed, retry_failed, review_stream, store_stream)
from ..streaming.store import read_rows
from .inputs import read, values
from .registry import query
from .scan import scan


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _re2(pattern: str) -> str:
    """DuckDB form of a secret pattern: its engine knows no u, d or U flag."""
    return _text(pattern.replace("(?iudU)", "(?i)").replace("(?dU)", ""))


def _scrub_sql(col: str, steps: int = len(SECRET_PATTERNS)) -> str:
    for secret in SECRET_PATTERNS[:steps]:
        replacement = _text(secret.replacement.replace("$1", r"\1"))
        col = f"regexp_replace({col}, {_re2(secret.pattern)}, {replacement}, 'g')"
    return col


@query("scrub_secrets", f"""
    SELECT doc_id, md5(clean) AS digest, CAST(length(clean) AS INT) AS length
    FROM (SELECT doc_id, {_scrub_sql("text")} AS clean FROM documents) d""")
def _(spark, sf):
    clean = scrub(read(spark, sf, "documents", spread=True).select("doc_id", "text"), "text")
    return clean.select("doc_id", F.md5("text").alias("digest"), F.length("text").alias("length"))


def _hits_sql(by: str = "") -> str:
    counts = " UNION ALL ".join(
        f"""SELECT {by + "," if by else ""} '{secret.name}' AS pattern, CAST(coalesce(sum(len(
          regexp_extract_all({_scrub_sql("text", i)}, {_re2(secret.pattern)}))), 0) AS BIGINT)
          AS hits FROM documents {"GROUP BY " + by if by else ""}"""
        for i, secret in enumerate(SECRET_PATTERNS))
    return counts


@query("secret_hits", _hits_sql())
def _(spark, sf):
    return secret_hits(read(spark, sf, "documents", spread=True), "text")


@query("secret_hits_by_source", _hits_sql("source"))
def _(spark, sf):
    return secret_hits(read(spark, sf, "documents", spread=True), "text", ["source"])


def blocks(spark, sf) -> DataFrame:
    return with_tokens(read(spark, sf, "blocks_v", spread=True))


def batches(spark, sf) -> DataFrame:
    return batching.assign_batches(blocks(spark, sf))


def graph(spark, sf) -> DataFrame:
    edges = read(spark, sf, "calls_v")
    ordered = F.sort_array(F.collect_list(F.struct("pos", "callee")))
    calls = edges.groupBy("repo", "ord", "caller").agg(  # three edges per definition
        F.transform(ordered, lambda e: e["callee"]).alias("callees"))
    return call_graph.latest_calls(calls, ("ord",))


@query("count_tokens", "SELECT repo, ord, tokens FROM tokens_v")
def _(spark, sf):
    return blocks(spark, sf).select("repo", "ord", "tokens")


@query("assign_batches", "SELECT repo, ord, tokens, batch_id FROM batches_v")
def _(spark, sf):
    return batching.assign(blocks(spark, sf).select("repo", "ord", "tokens"))


@query("batch_stats", """
    SELECT repo, batch_id, count(*) AS blocks, CAST(sum(tokens) AS BIGINT) AS tokens
    FROM batches_v GROUP BY repo, batch_id""")
def _(spark, sf):
    return batching.batch_stats(batching.assign(blocks(spark, sf).select("repo", "ord", "tokens")))


@query("batch_totals", """
    SELECT repo, count(*) AS blocks, max(batch_id) + 1 AS batches,
      CAST(sum(tokens) AS BIGINT) AS tokens FROM batches_v GROUP BY repo""")
def _(spark, sf):
    return batching.batch_totals(batching.assign(blocks(spark, sf).select("repo", "ord", "tokens")))


@query("cap_batches", """
    SELECT repo, ord, batch_id FROM batches_v WHERE batch_id < 3 + ascii(right(repo, 1)) % 5""")
def _(spark, sf):
    ids = batching.assign(blocks(spark, sf).select("repo", "ord", "tokens"))
    targets = read(spark, sf, "blocks_v", spread=True).select("repo").distinct().withColumn(
        "max_batches", F.lit(3) + F.ascii(F.expr("right(repo, 1)")) % 5)
    return batching.cap_batches(ids, None, targets).select("repo", "ord", "batch_id")


@query("latest_calls", """
    SELECT repo, caller, any_value(first_ord) AS first_ord,
      string_agg(callee, ', ' ORDER BY pos) AS callees FROM latest_calls_v GROUP BY repo, caller""")
def _(spark, sf):
    return graph(spark, sf).select("repo", "caller", F.col("first.ord").alias("first_ord"),
                                   F.array_join("callees", ", ").alias("callees"))


@query("callers", "SELECT repo, name, callers FROM callers_v")
def _(spark, sf):
    found = call_graph.callers(graph(spark, sf))
    return found.withColumn("callers", F.array_join("callers", ", "))


@query("callees", "SELECT repo, name, callees FROM callees_v")
def _(spark, sf):
    found = call_graph.callees(graph(spark, sf))
    return found.withColumn("callees", F.array_join("callees", ", "))


@query("call_context", """
    SELECT ord, b.repo, b.name, CASE WHEN k.name IS NULL THEN NULL ELSE coalesce(callers, '') END
      AS callers, callees
    FROM blocks_v b LEFT JOIN callees_v k ON b.repo = k.repo AND b.name = k.name
    LEFT JOIN callers_v c ON b.repo = c.repo AND b.name = c.name""")
def _(spark, sf):
    found = call_graph.with_call_context(read(spark, sf, "blocks_v", spread=True), graph(spark, sf))
    return found.select("ord", "repo", "name", F.array_join("callers", ", ").alias("callers"),
                        F.array_join("callees", ", ").alias("callees"))


@query("build_prompts", f"""
    SELECT repo, batch_id, CAST(length(prompt) AS INT) AS length, md5(prompt) AS digest FROM (
      SELECT repo, batch_id, string_agg(section, '' ORDER BY ord) AS prompt FROM (
        SELECT b.repo, w.batch_id, b.ord, concat(chr(10), '---', chr(10), 'File: `', file_path,
          '` | Language: ', language, ' | Line: ', line_number, ' | Type: ', type, ' | Name: `',
          b.name, '`', chr(10), CASE WHEN callers <> '' THEN 'Called by: ' || callers || chr(10)
          ELSE '' END, CASE WHEN callees <> '' THEN 'Calls: ' || callees || chr(10) ELSE '' END,
          '```python', chr(10), {_scrub_sql("code")}, chr(10), '```', chr(10)) AS section
        FROM blocks_v b JOIN batches_v w ON b.repo = w.repo AND b.ord = w.ord
        LEFT JOIN callers_v c ON b.repo = c.repo AND b.name = c.name
        LEFT JOIN callees_v k ON b.repo = k.repo AND b.name = k.name) s
      GROUP BY repo, batch_id) p""")
def _(spark, sf):
    built = prompts.build_prompts(batches(spark, sf), graph(spark, sf))
    return built.select("repo", "batch_id", F.length("prompt").alias("length"),
                        F.md5("prompt").alias("digest"))


_REVIEW_WALK = "doc_id % 7 NOT IN (3, 4, 5)"


@query("review_walk", f"SELECT path FROM files_v WHERE {_REVIEW_WALK}")
def _(spark, sf):
    return files.prune_dirs(read(spark, sf, "files_v")).select("path")


@query("call_graph_walk", "SELECT path FROM files_v WHERE doc_id % 7 <> 4")
def _(spark, sf):
    return files.prune_dirs(read(spark, sf, "files_v"), "call_graph").select("path")


@query("file_language", """
    SELECT path, language, fence, ext FROM (SELECT path, CASE t WHEN 4 THEN 'javascript'
        WHEN 5 THEN 'javascript' WHEN 6 THEN 'tsx' WHEN 8 THEN NULL ELSE 'python' END AS language,
      '.' || string_split(path, '.')[-1] AS ext FROM files_v), LATERAL (SELECT language AS fence)
    WHERE language IS NOT NULL""")
def _(spark, sf):
    kept = files.with_language(read(spark, sf, "files_v"))
    return kept.select("path", "language", paths.code_fence(F.col("language")).alias("fence"),
                       paths.extension(F.col("path")).alias("ext"))


@query("drop_blank", "SELECT path FROM files_v WHERE t <> 7")
def _(spark, sf):
    return files.drop_blank(read(spark, sf, "files_v")).select("path")


@query("decode_text", """
    SELECT doc_id, md5(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)))
      AS digest FROM documents""")
def _(spark, sf):
    raw = read(spark, sf, "documents", spread=True).select("doc_id", "text")
    crlf = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n")))
    stored = raw.withColumn("content", F.coalesce(crlf, F.col("text")).cast("binary"))
    return files.decode(stored).select("doc_id", F.md5("content").alias("digest"))


@query("source_files", f"""
    SELECT path, language, {_REVIEW_WALK} AS reviewable FROM (SELECT *, CASE WHEN t IN (4, 5)
      THEN 'javascript' WHEN t = 6 THEN 'tsx' ELSE 'python' END AS language FROM files_v) f
    WHERE t NOT IN (7, 8) AND doc_id % 7 <> 4 AND ({_REVIEW_WALK} OR language = 'python')""")
def _(spark, sf):
    return files.source_files(read(spark, sf, "files_v")).select("path", "language", "reviewable")


def definitions(spark, sf) -> DataFrame:
    return extract.extract_definitions(read(spark, sf, "files_v", spread=True))


_BLOCK_SQL = """SELECT repo, path AS file_path, name, type, line_number, code,
    docstring, language, ord FROM expected_v"""


@query("python_blocks", f"{_BLOCK_SQL} WHERE language = 'python'")
def _(spark, sf):
    return extract.to_blocks(definitions(spark, sf)).filter("language = 'python'")


@query("script_blocks", f"{_BLOCK_SQL} WHERE language <> 'python'")
def _(spark, sf):
    return extract.to_blocks(definitions(spark, sf)).filter("language <> 'python'")


@query("ordered_blocks", """
    SELECT repo, file_path, name, row_number() OVER (PARTITION BY repo
      ORDER BY language <> 'python', file_path, ord) - 1 AS ord
    FROM (SELECT *, path AS file_path FROM expected_v) e""")
def _(spark, sf):
    parsed = materialize(definitions(spark, sf), "definitions")  # read four times below
    found = extract.to_blocks(parsed)
    python, script = (found.filter(c) for c in ("language = 'python'", "language <> 'python'"))
    return extract.order_blocks(extract.union_blocks(python, script)).select(
        "repo", "file_path", "name", "ord")


@query("call_edges", "SELECT repo, path, ord, caller, callees FROM expected_calls_v")
def _(spark, sf):
    return extract.to_calls(definitions(spark, sf)).withColumn(
        "callees", F.array_join("callees", ","))


@query("file_call_graph", """
    SELECT repo, caller, callees FROM (SELECT *, row_number() OVER (PARTITION BY repo, caller
      ORDER BY path DESC, ord DESC) AS r FROM expected_calls_v) c WHERE r = 1""")
def _(spark, sf):
    found = call_graph.latest_calls(extract.to_calls(definitions(spark, sf)))
    return found.select("repo", "caller", F.array_join("callees", ",").alias("callees"))


@query("parse_errors", f"""
    SELECT repo, path, 'python' AS language, 'SyntaxError' AS kind FROM files_v
    WHERE t = 3 AND {_REVIEW_WALK}""")
def _(spark, sf):
    return extract.parse_errors(definitions(spark, sf)).select(
        "repo", "path", "language", F.substring_index("error", ":", 1).alias("kind"))


@query("extraction_stats", f"""
    SELECT repo, python_files, python_parsed, count(e.repo) AS blocks FROM (
      SELECT repo, count(*)
      FILTER (t IN (0, 1, 2, 3, 7) AND {_REVIEW_WALK}) AS python_files,
      count(*) FILTER (t IN (0, 1, 2) AND {_REVIEW_WALK}) AS python_parsed
      FROM files_v GROUP BY repo) f
    LEFT JOIN expected_v e USING (repo) GROUP BY 1, 2, 3""")
def _(spark, sf):
    parsed = materialize(definitions(spark, sf), "definitions")
    return extract.extraction_stats(read(spark, sf, "files_v"), parsed)


def _cut_sql(code: str) -> str:
    return f"""CASE WHEN length({code}) > 8000 THEN substring({code}, 1, 8000) || chr(10) ||
      '    # ... [truncated — function exceeds max length]' ELSE {code} END"""


@query("truncate_code", f"""
    SELECT ord, md5({_cut_sql("code")}) AS digest FROM blocks_v""")
def _(spark, sf):
    cut = extract.truncate_code(read(spark, sf, "blocks_v", spread=True))
    return cut.select("ord", F.md5("code").alias("digest"))


@query("long_blocks", f"""
    SELECT path AS file_path, name, line_number, md5({_cut_sql("code")}) AS digest FROM (
      SELECT path, concat('d', doc_id) AS name, CAST(1 AS INT) AS line_number,
        rtrim(content, chr(10)) AS code FROM long_files_v) f""")
def _(spark, sf):
    found = extract.truncate_code(extract.to_blocks(
        extract.extract_definitions(read(spark, sf, "long_files_v", spread=True))))
    return found.select("file_path", "name", "line_number", F.md5("code").alias("digest"))


_FOUND = values([
    (0, "f@", 2, "DIV_PY", "Medium"), (1, "load", 2, "DESER_PY", "Critical"),
    (2, "q@", 1, "SQLI_PY", "Critical"), (4, "g@", 1, "XSS_JS", "High"),
    (5, "run", 0, "SQLI_JS", "Critical"),
], "t, name, below, rule, severity")
_FOUND_SQL = f"""SELECT e.repo, e.path AS file_path, e.name AS function_name,
      e.line_number + r.below AS line_number, r.rule, r.severity FROM expected_v e
    JOIN ({_FOUND}) r ON e.t = r.t AND e.name = replace(r.name, '@', CAST(doc_id AS STRING))"""


@query("review_rules", _FOUND_SQL)
def _(spark, sf):
    found = review.review_rules(extract.to_blocks(definitions(spark, sf)))
    return found.select("repo", "file_path", "function_name", "line_number", "rule", "severity")


def _rule_sql(rule: review.Rule) -> str:
    """All matches: the text before match i is i pieces and i - 1 matches."""
    pattern = _text(rule.pattern)
    return f"""SELECT DISTINCT ord, '{rule.rule}' AS rule, {rule.confidence} AS confidence_score,
        CAST(line_number + length(prefix) - length(replace(prefix, chr(10), '')) AS INT)
          AS line_number, trim(string_split(prefix, chr(10))[-1] ||
          string_split(substr(code, length(prefix) + 1), chr(10))[1]) AS vulnerable_snippet
      FROM (SELECT ord, line_number, code, left(code, CAST(list_sum(list_transform(pieces[1:i],
              lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1],
              lambda x: length(x))), 0) AS BIGINT)) AS prefix
            FROM (SELECT ord, line_number, code, string_split_regex(code, {pattern}) AS pieces,
                    regexp_extract_all(code, {pattern}) AS hits FROM clean
                  WHERE language IN ({', '.join(f"'{x}'" for x in rule.languages)})
                    AND regexp_matches(code, {pattern})) p,
              LATERAL (SELECT unnest(range(1, len(hits) + 1)) AS i) n) m"""


@query("review_whole_texts", f"""
    WITH clean AS (SELECT ord, line_number, {_scrub_sql("code")} AS code, language
      FROM rule_blocks_v)
    {" UNION ALL ".join(_rule_sql(r) for r in review.RULES)}""")
def _(spark, sf):
    found = review.review_rules(read(spark, sf, "rule_blocks_v", spread=True))
    return found.select(F.col("block_ord").alias("ord"), "rule", "confidence_score",
                        "line_number", "vulnerable_snippet")


# One expectation per file, also for files below ignored folders and one no rule covers.
_ISSUES = values([
    (0, "f@", "Bug"), (1, "load", "Security"), (2, "q@", "Security"), (4, "g@", "Security"),
    (5, "run", "Security"), (6, "check", "Security"),
], "t, name, category")
_EXPECTED_SQL = f"""SELECT DISTINCT repo, replace(name, '@', CAST(doc_id AS STRING))
    AS function_name, category FROM files_v f JOIN ({_ISSUES}) i ON f.t = i.t"""
_HIT_SQL = f"SELECT DISTINCT repo, function_name FROM ({_FOUND_SQL}) f"


def _expected(spark, sf) -> DataFrame:
    issues = spark.sql(_ISSUES)
    name = F.replace("name", F.lit("@"), F.col("doc_id").cast("string")).alias("function_name")
    return read(spark, sf, "files_v").join(issues, "t").select("repo", name, "category").distinct()


def _found(spark, sf) -> DataFrame:
    return review.review_rules(extract.to_blocks(definitions(spark, sf)))


@query("recall_by_repo", f"""
    SELECT repo, count(*) AS expected, count(h.function_name) AS found,
      count(h.function_name) / count(*) AS recall, count(h.function_name) / count(*) >= 0.75
        AS passed
    FROM ({_EXPECTED_SQL}) e LEFT JOIN ({_HIT_SQL}) h USING (repo, function_name) GROUP BY repo""")
def _(spark, sf):
    return recall.recall(_found(spark, sf), _expected(spark, sf), ["repo"])


@query("expected_found", f"""
    SELECT * FROM ({_EXPECTED_SQL}) e JOIN ({_HIT_SQL}) h USING (repo, function_name)""")
def _(spark, sf):
    return recall.expected_found(_found(spark, sf), _expected(spark, sf))


@query("expected_hits", f"""
    SELECT repo, function_name FROM ({_EXPECTED_SQL}) e INTERSECT {_HIT_SQL}""")
def _(spark, sf):
    return recall.hits(_found(spark, sf), _expected(spark, sf))


@query("expected_missed", f"""
    SELECT repo, function_name FROM ({_EXPECTED_SQL}) e EXCEPT {_HIT_SQL}""")
def _(spark, sf):
    return recall.missed(_found(spark, sf), _expected(spark, sf))


@query("languages", f"""SELECT DISTINCT repo, language FROM expected_v""")
def _(spark, sf):
    return extract.to_blocks(definitions(spark, sf)).select("repo", "language").distinct()


def notes(source: str):
    """Definitions of a language of one's own: a line that begins with def."""
    for number, line in enumerate(source.split("\n"), 1):
        if found := re.match(r"def (\w+)", line):
            yield {"name": found[1], "type": "note", "line_number": number, "code": line}


@query("added_language", """
    SELECT repo, path AS file_path, concat('not_code', doc_id) AS name, 'note' AS type,
      CAST(1 AS INT) AS line_number, concat('def not_code', doc_id, '(): pass') AS code,
      'notes' AS language
    FROM files_v WHERE t = 8 AND doc_id % 7 NOT IN (3, 4, 5)""")
def _(spark, sf):
    """Blocks of files that only a registered language reads."""
    with extract.added_language(".md", "notes", notes):
        found = extract.to_blocks(definitions(spark, sf))
    return found.where("language = 'notes'").select(
        "repo", "file_path", "name", "type", "line_number", "code", "language")


def counting_reviewer(repo: str, batch_id: int, prompt: str) -> dict:
    """One finding per batch that says how many blocks it got; refuses every seventh batch."""
    if batch_id % 7 == 3:
        raise RuntimeError("refused")
    return steady_reviewer(repo, batch_id, prompt)


def steady_reviewer(repo: str, batch_id: int, prompt: str) -> dict:
    blocks = prompt.count("\n---\nFile: `")
    return {"reviews": [{
        "file_path": "src", "function_name": "all", "line_number": blocks,
        "issue_category": "Style", "severity": "Low", "comment": f"{blocks} blocks",
        "suggested_fix": "none", "vulnerable_snippet": "", "impact": "",
        "confidence_score": 70 + blocks, "needs_verification": False}],
        "batch_summary": f"batch {batch_id}"}


def ruling_reviewer(repo: str, batch_id: int, prompt: str) -> dict:
    """Findings of one rule on the text of each section of a prompt."""
    found = []
    for section in prompt.split("\n---\nFile: `")[1:]:
        path, name = re.match(r"(.*?)`[^\n]*Name: `(.*?)`\n", section).groups()
        found += [{
            "file_path": path, "function_name": name, "line_number": 1, "issue_category": "Security",
            "severity": "Critical", "comment": "unsafe deserialization", "suggested_fix": "none",
            "vulnerable_snippet": line.strip(), "impact": "", "confidence_score": 95,
            "needs_verification": False}
            for line in section.split("\n") if "pickle.loads(" in line]
    return {"reviews": found, "batch_summary": ""}


_COUNTED = "SELECT repo, batch_id, count(*) AS n FROM batches_v GROUP BY repo, batch_id"


@query("review_batches", f"""
    SELECT repo, batch_id, CAST(n AS INT) AS line_number,
      CAST(least(100, 70 + n) AS INT) AS confidence_score, n < 10 AS needs_verification
    FROM ({_COUNTED}) b WHERE batch_id % 7 <> 3""")
def _(spark, sf):
    built = prompts.build_prompts(batches(spark, sf))
    found = review.parse_reports(review.review_batches(built, counting_reviewer))[0]
    return found.select("repo", "batch_id", "line_number", "confidence_score",
                        "needs_verification")


@query("failed_batches", f"""
    SELECT repo, batch_id, 'RuntimeError: refused' AS error FROM ({_COUNTED}) b
    WHERE batch_id % 7 = 3""")
def _(spark, sf):
    built = prompts.build_prompts(batches(spark, sf))
    return review.batch_errors(review.review_batches(built, counting_reviewer))


def refusing_reviewer(repo: str, batch_id: int, prompt: str) -> dict:
    """Refuses prompts that show files of one folder, and says how many of them."""
    if refused := prompt.count("\n---\nFile: `src/es/"):
        raise ValueError(f"{refused} files not read")
    return steady_reviewer(repo, batch_id, prompt)


@query("refused_batches", f"""
    WITH n AS (SELECT b.repo, batch_id, count(*) AS n,
        count(*) FILTER (contains(file_path, 'src/es/')) AS refused
      FROM batches_v b JOIN blocks_v k ON k.repo = b.repo AND k.ord = b.ord GROUP BY ALL)
    SELECT repo, batch_id, CASE WHEN refused = 0 THEN CAST(n AS INT) ELSE 0 END AS blocks,
      CASE WHEN refused > 0 THEN 'ValueError: ' || refused || ' files not read' ELSE '' END
        AS error
    FROM n""")
def _(spark, sf):
    """A reviewer that fails on what a prompt holds, with calls in flight."""
    built = prompts.build_prompts(batches(spark, sf))
    reviewed = review.review_batches(built, refusing_reviewer, in_flight=8)
    parsed = F.from_json("report", "reviews array<struct<line_number int>>")
    blocks = F.get(parsed["reviews"], F.lit(0))["line_number"]
    return reviewed.select("repo", "batch_id", F.coalesce(blocks, F.lit(0)).alias("blocks"),
                           F.coalesce("error", F.lit("")).alias("error"))


def _streamed(spark, sf, reviewer) -> tuple[str, str]:
    """Prompts written as batch files and reviewed by a stream that then stops."""
    source, out = fresh_path(spark, "prompts"), fresh_path(spark, "reviewed")
    prompts.build_prompts(batches(spark, sf)).write.parquet(source)
    for _ in range(2):  # the second run finds nothing to do
        review_stream(spark, source, out, f"{out}-checkpoint", reviewer).awaitTermination()
    return source, out


@query("stream_review", f"""
    SELECT repo, batch_id, CAST(n AS INT) AS line_number FROM ({_COUNTED}) b""")
def _(spark, sf):
    source, out = _streamed(spark, sf, counting_reviewer)
    retry_failed(spark, source, out, steady_reviewer)
    return review.parse_reports(read_reviewed(spark, out))[0].select(
        "repo", "batch_id", "line_number")


def _stored(spark, sf, reviewer) -> tuple[str, str, DataFrame]:
    """A review store that a stream filled in several epochs, its prompts, and its progress."""
    source, store = fresh_path(spark, "prompts"), fresh_path(spark, "store")
    built = prompts.build_prompts(batches(spark, sf))
    built.repartition(4, "repo", "batch_id").write.parquet(source)
    with ProgressListener(spark) as listener:
        run = store_stream(spark, source, store, f"{store}-checkpoint", reviewer, files_per_run=1)
        run.awaitTermination()
        listener.wait(run)
    return source, store, listener.table()


@query("stream_store", f"""
    SELECT repo, batch_id, CAST(n AS INT) AS line_number FROM ({_COUNTED}) b""")
def _(spark, sf):
    """Files of a store after all its epochs came a second time, as from a lost checkpoint."""
    source, store, _ = _stored(spark, sf, counting_reviewer)
    store_stream(spark, source, store, f"{store}-again", steady_reviewer,
                 files_per_run=1).awaitTermination()
    return review.parse_reports(read_rows(spark, store).drop("epoch"))[0].select(
        "repo", "batch_id", "line_number")


@query("stream_progress", f"""
    SELECT repo, count(*) FILTER (batch_id % 7 <> 3) AS done,
      count(*) FILTER (batch_id % 7 = 3) AS failed,
      CAST(sum(count(*) FILTER (batch_id % 7 <> 3)) OVER () AS BIGINT) AS all_done,
      CAST(sum(count(*) FILTER (batch_id % 7 = 3)) OVER () AS BIGINT) AS all_failed
    FROM ({_COUNTED}) b GROUP BY repo""")
def _(spark, sf):
    """Counts of each repository from the store, and of all from the events of its epochs."""
    _, store, told = _stored(spark, sf, counting_reviewer)
    whole = told.agg(F.sum("done").alias("all_done"), F.sum("failed").alias("all_failed")).first()
    return repo_progress(spark, store, told).groupBy("repo").agg(
        F.sum("done").alias("done"), F.sum("failed").alias("failed")).withColumns(
        {name: F.lit(whole[name]).cast("long") for name in ("all_done", "all_failed")})


@query("review_progress", f"""
    SELECT repo, count(*) FILTER (batch_id % 7 <> 3) AS done, count(*) AS total,
      count(*) FILTER (batch_id % 7 <> 3) / count(*) AS ratio FROM ({_COUNTED}) b GROUP BY repo""")
def _(spark, sf):
    source, out = _streamed(spark, sf, counting_reviewer)
    return review.review_progress(spark.read.schema(
        "repo string, batch_id long, prompt string").parquet(source), read_reviewed(spark, out))


def _corpus(spark, sf) -> str:
    path = fresh_path(spark, "corpus")
    write_corpus(read(spark, sf, "files_v").withColumn("content", F.col("content").cast("binary")),
                 path)
    return path


@query("read_corpus", "SELECT repo, path, md5(content) AS digest FROM files_v WHERE repo = 'src3'")
def _(spark, sf):
    found = read_corpus(spark, _corpus(spark, sf), ["src3"])
    return found.select("repo", "path", F.md5("content").alias("digest"))


@query("read_whole_corpus", "SELECT repo, path, md5(content) AS digest FROM files_v")
def _(spark, sf):
    """All repositories, read back from the corpus they were written to."""
    return read_corpus(spark, _corpus(spark, sf)).select(
        "repo", "path", F.md5("content").alias("digest"))


@query("corpus_files", """
    SELECT f.repo, f.path, md5(content) AS digest FROM files_v f JOIN (
      SELECT repo, max(path) AS path FROM files_v GROUP BY repo) l
    ON l.repo = f.repo AND l.path = f.path""")
def _(spark, sf):
    """The last file of every repository, looked up by name."""
    wanted = read(spark, sf, "files_v").groupBy("repo").agg(F.max("path").alias("path"))
    found = read_files(_corpus(spark, sf), wanted)
    return found.select("repo", "path", F.md5("content").alias("digest"))


@query("scan_reviewed", f"""
    SELECT repo, path AS file_path, name AS function_name FROM expected_v
    WHERE contains({_cut_sql("code")}, 'pickle.loads(')""")
def _(spark, sf):
    """A scan with a reviewer of its own, which sees prompts, in which long code is cut."""
    found = scan(read(spark, sf, "files_v", spread=True), reviewer=ruling_reviewer).findings
    return found.select("repo", "file_path", "function_name")


@query("observed_progress", f"""
    SELECT count(*) FILTER (batch_id % 7 <> 3) AS done, count(*) FILTER (batch_id % 7 = 3) AS failed
    FROM ({_COUNTED}) b""")
def _(spark, sf):
    """Counts taken while reviewed batches are written."""
    progress = Observation("progress")
    reviewed = review.review_batches(prompts.build_prompts(batches(spark, sf)), counting_reviewer)
    observe_progress(reviewed, progress).write.parquet(fresh_path(spark, "observed"))
    return spark.createDataFrame([(progress.get["done"], progress.get["failed"])],
                                 "done long, failed long")


def _written_tree(spark, sf, path: str) -> str:
    """Folder of files that executors wrote, named by the SQL `path`, in the folder they share."""
    root = fresh_path(spark, "tree")
    local = urlparse(root).path  # the tree is read with the functions of a local file system

    def write(rows) -> None:
        for row in rows:
            os.makedirs(os.path.dirname(f"{local}/{row.path}"), exist_ok=True)
            with open(f"{local}/{row.path}", "wb") as f:
                f.write(row.content.encode())

    os.makedirs(local, exist_ok=True)
    read(spark, sf, "files_v", spread=True).selectExpr(
        f"{path} AS path", "content").foreachPartition(write)
    return local


@query("read_tree", """
    SELECT path, md5(content) AS digest FROM files_v WHERE doc_id % 7 <> 4 AND t <> 8""")
def _(spark, sf):
    """Files written as a tree and read back, listed by executors."""
    root = _written_tree(spark, sf, "path")
    return read_tree(spark, root, "r").select("path", F.md5("content").alias("digest"))


@query("tree_source", """
    SELECT repo, path, md5(content) AS digest FROM files_v WHERE doc_id % 7 <> 4 AND t <> 8""")
def _(spark, sf):
    """Trees of all repositories below one folder, read as a Spark format."""
    tree_source.register(spark)
    root = _written_tree(spark, sf, "concat(repo, '/', path)")
    found = spark.read.format(tree_source.FORMAT).option("repos", "true").load(root)
    return found.select("repo", "path", F.md5("content").alias("digest"))


@query("tree_source_filtered", """
    SELECT repo, path, md5(content) AS digest FROM files_v
    WHERE path LIKE 'lib/%' AND path LIKE '%.py' AND repo IN ('src1', 'src3', 'src4')""")
def _(spark, sf):
    """Of all trees, the files that filters select; the format opens no others."""
    tree_source.register(spark)
    root = _written_tree(spark, sf, "concat(repo, '/', path)")
    found = spark.read.format(tree_source.FORMAT).options(repos="true", suffixes="").load(root)
    return found.where(F.col("path").startswith("lib/") & F.col("path").endswith(".py")
                       & F.col("repo").isin("src1", "src3", "src4")).select(
        "repo", "path", F.md5("content").alias("digest"))


@query("scan_health", f"""
    SELECT repo, findings, CAST(round_even(raw, 0) AS BIGINT) AS score,
      CASE WHEN raw >= 90 THEN 'A' WHEN raw >= 75 THEN 'B' WHEN raw >= 60 THEN 'C'
        WHEN raw >= 40 THEN 'D' ELSE 'F' END AS grade,
      CASE WHEN raw >= 90 THEN '#22C55E' WHEN raw >= 75 THEN '#84CC16' WHEN raw >= 60
        THEN '#F5A623' WHEN raw >= 40 THEN '#F97316' ELSE '#EF4444' END AS color
    FROM (SELECT repo, count(rule) AS findings, (10000 - least(10000, coalesce(sum(
      CASE rule WHEN 'DIV_PY' THEN 4 * 80 WHEN 'XSS_JS' THEN 10 * 90 ELSE 25 * 95 END)
      FILTER (rule IS NOT NULL), 0))) / 100 AS raw
      FROM (SELECT DISTINCT source AS repo FROM documents) e LEFT JOIN ({_FOUND_SQL}) f USING (repo)
      GROUP BY repo) s""")
def _(spark, sf):
    return scan(read(spark, sf, "files_v", spread=True)).health
