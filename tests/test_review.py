from __future__ import annotations

import glob
import json
import os
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import Observation
from pyspark.sql import functions as F

from reviewlake import session
from reviewlake.functions.cwe import with_cwe
from reviewlake.operators import extract, recall, review
from reviewlake.operators.findings import by_function
from reviewlake.plans.scan import indexed, scan
from reviewlake.schemas import FILES, PROMPTS
from reviewlake.session import fresh_path
from reviewlake.streaming.reviews import (
    observe_progress, read_reviewed, retry_failed, review_stream)

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # reviewers run in workers

# Own files with the defects a review has to find.
PYTHON = '''
import pickle
import subprocess


def read_state(raw):
    return pickle.loads(raw)


def start(line):
    subprocess.run(line, shell=True)


def ratio(a, b):
    return a / b


def users(db):
    q = f"SELECT name FROM people WHERE id = {input()}"
    return db.execute(q)


def by_mail(db, mail):
    q = "SELECT name FROM people WHERE mail = '" + mail + "'"
    return db.execute(q)


def card(name):
    return f"<p class='card'>{name}</p>"


class Clean:
    def add(self, a, b):
        return a + b
'''
SCRIPT = '''
function showNote(text) {
    const box = document.getElementById("notes");
    box.innerHTML = text;
}

function findByMail(db, mail) {
    return db.query(`SELECT * FROM people WHERE mail='${mail}'`);
}
'''
TYPED = '''
class Checker {
  isMail(text: string): boolean {
    return text.includes("@");
  }
}
'''
EXPECTED = {
    "read_state": "CWE-502", "start": "CWE-78", "ratio": "CWE-369", "users": "CWE-89",
    "by_mail": "CWE-89", "card": "CWE-79", "showNote": "CWE-79", "findByMail": "CWE-89",
}


@pytest.fixture(scope="module")
def golden(spark):
    rows = [("r", "bad.py", PYTHON), ("r", "bad.js", SCRIPT), ("r", "ok.ts", TYPED)]
    return spark.createDataFrame([(r, p, c.encode()) for r, p, c in rows], FILES)


def test_every_planted_issue_is_found_and_classified(spark, golden):
    found = review.review_rules(extract.to_blocks(extract.extract_definitions(golden)))
    expected = spark.createDataFrame([("r", n) for n in EXPECTED], "repo string, function_name string")
    row = recall.recall(found, expected).first()
    assert (row.expected, row.found, row.recall, row.passed) == (8, 8, 1.0, True)
    assert recall.missed(found, expected).count() == 0
    classes = {r.function_name: r.cwe_id for r in with_cwe(found).collect()}
    assert classes == EXPECTED  # and nothing in the clean functions
    assert {r.function_name: r.cwe_ids for r in by_function(found).collect()} == {
        n: [c] for n, c in EXPECTED.items()}


def test_lines_and_snippets(spark, golden):
    found = review.review_rules(extract.to_blocks(extract.extract_definitions(golden)))
    at = {r.function_name: (r.line_number, r.vulnerable_snippet) for r in found.collect()}
    text = {"bad.py": PYTHON, "bad.js": SCRIPT}
    for r in found.collect():
        assert text[r.file_path].split("\n")[r.line_number - 1].strip() == r.vulnerable_snippet
    assert at["ratio"] == (15, "return a / b")


@pytest.mark.parametrize("language,code,rules", [
    ("python", "os.system(x)", {"CMD_PY"}), ("javascript", "os.system(x)", set()),
    ("javascript", "child_process.exec(x)", {"CMD_JS"}), ("tsx", "eval(x)", {"DESER_JS"}),
    ("typescript", "_.merge(a, b)", {"PROTO_JS"}), ("javascript", "o[key] = v", {"PROTO_JS"}),
    ("javascript", "o[key] == v", set()), ("javascript", "document.writeln(x)", {"XSS_JS"}),
    ("javascript", "<div dangerouslySetInnerHTML={x}/>", {"XSS_JS"}),
    ("javascript", "q = 'DELETE FROM t ' + x", {"SQLI_JS"}), ("python", "f'<b>{x}'", {"XSS_PY"}),
    ("python", "q = 'delete from t ' + x; pickle.load(f)", {"SQLI_PY", "DESER_PY"})])
def test_rules(spark, language, code, rules):
    block = spark.createDataFrame([("r", "f", "n", 3, 0, language, code)],
                                  "repo string, file_path string, name string, line_number int, "
                                  "ord int, language string, code string")
    assert {r.rule for r in review.review_rules(block).collect()} == rules


def test_a_hit_belongs_to_the_innermost_definition(spark):
    source = "class A:\n    def outer(self):\n        def inner():\n            os.system(x)\n"
    df = spark.createDataFrame([("r", "a.py", source.encode())], FILES)
    found = review.review_rules(extract.to_blocks(extract.extract_definitions(df))).collect()
    assert [(r.function_name, r.line_number) for r in found] == [("inner", 4)]


def test_every_match_in_whole_code_is_found(spark):
    code = "os.system(a)\nos.system(b); os.system(c)\n" + "x = 1\n" * 4000 + "  os.system(d)\n"
    df = spark.createDataFrame([("r", "f.py", "f", 10, 0, code, "python")], "repo string, "
                               "file_path string, name string, line_number int, ord int, "
                               "code string, language string")
    found = review.review_rules(df).orderBy("line_number").collect()
    assert [(f.line_number, f.vulnerable_snippet) for f in found] == [
        (10, "os.system(a)"), (11, "os.system(b); os.system(c)"), (4012, "os.system(d)")]


def test_many_hits_on_a_line_are_one_row(spark):
    """Rows hold no more text than the code, however many matches a line has."""
    line = "x = eval(a); " * 20_000  # 260 KB
    code = "\x01 first\n" + line * 4 + "\n" + line + "\n" + "a = 1\n" * 20_000 + "eval(z)"
    blocks = spark.createDataFrame([("r", "a.js", "f", "function", 10, code, None, "javascript", 0)],
                                   "repo string, file_path string, name string, type string, "
                                   "line_number int, code string, docstring string, "
                                   "language string, ord int")
    began = time.perf_counter()
    hits = review.rule_hits(blocks, ["repo", "file_path", "name", "line_number", "ord"]).collect()
    assert time.perf_counter() - began < 10
    assert sorted((h._line, len(h._snippet)) for h in hits) == [
        (11, 4 * len(line)), (12, len(line)), (20_013, 7)]
    assert sum(len(h._snippet) for h in hits) <= len(code)


def test_a_match_over_lines_belongs_to_its_first(spark):
    code = "q = 1\nx = `\nselect \n${a}`; eval(b)\neval(c)"
    blocks = spark.createDataFrame([("r", "a.js", "f", "function", 1, code, None, "javascript", 0)],
                                   "repo string, file_path string, name string, type string, "
                                   "line_number int, code string, docstring string, "
                                   "language string, ord int")
    found = review.review_rules(blocks).collect()
    assert sorted((f.rule, f.line_number, f.vulnerable_snippet) for f in found) == [
        ("DESER_JS", 4, "${a}`; eval(b)"), ("DESER_JS", 5, "eval(c)"), ("SQLI_JS", 2, "x = `")]


def batches_of(spark, n, parts):
    return spark.range(n, numPartitions=parts).select(
        F.lit("r").alias("repo"), F.col("id").alias("batch_id"),
        F.concat(F.lit("p"), "id").alias("prompt"))


def sleepy(repo, batch_id, prompt):
    time.sleep(0.05)
    if batch_id % 10 == 3:
        raise ValueError(prompt)
    return {"reviews": [], "batch_summary": prompt}


def test_calls_in_flight(spark):
    """1,000 batches of 50 ms: 50 s one after the other, a tenth of it ten at a time."""
    review.review_batches(batches_of(spark, 8, 1), sleepy).collect()  # starts the worker
    began = time.perf_counter()
    rows = review.review_batches(batches_of(spark, 1000, 1), sleepy, in_flight=20).collect()
    assert time.perf_counter() - began < 5
    assert [r.batch_id for r in rows] == list(range(1000))
    for r in rows:
        assert r.error == (f"ValueError: p{r.batch_id}" if r.batch_id % 10 == 3 else None)
        assert r.error or json.loads(r.report)["batch_summary"] == f"p{r.batch_id}"


def test_calls_per_second(spark):
    def quick(repo, batch_id, prompt):
        return {"at": time.time()}

    rows = review.review_batches(batches_of(spark, 60, 1), quick, in_flight=8,
                                 calls_per_second=20).collect()
    times = sorted(json.loads(r.report)["at"] for r in rows)
    assert 1.7 < times[-1] - times[0] < 4  # 20 at once, 40 more at 20 a second


def test_clean_repos_stay(spark):
    late = "def f(c):\n" + "    x = 1\n" * 2000 + "    os.system(c)\n"
    rows = [("broken", "a.py", b"def ("), ("empty", "a.py", b"x = 1"), ("notes", "a.md", b"text"),
            ("late", "a.py", late.encode())]
    result = scan(spark.createDataFrame(rows, FILES))
    assert {r.repo: (r.findings, r.score) for r in result.health.collect()} == {
        "broken": (0, 100), "empty": (0, 100), "notes": (0, 100), "late": (1, 76)}


def test_scan_end_to_end(spark, golden):
    bad = spark.createDataFrame([("r", "x.py", b"def (:"), ("clean", "a.py", b"def f(): pass")], FILES)
    result = scan(golden.union(bad))
    assert [e.path for e in result.parse_errors.collect()] == ["x.py"]
    health = {h.repo: (h.findings, h.score, h.grade) for h in result.health.collect()}
    assert health == {"r": (8, 0, "F"), "clean": (0, 100, "A")}
    rows = indexed(result.findings).orderBy("idx").collect()
    assert [r.idx for r in rows] == list(range(8)) and rows[0].function_name == "read_state"
    assert scan(golden, languages=["python"]).findings.count() == 6


def one_per_block(repo, batch_id, prompt):
    names = [part.split("`")[0] for part in prompt.split("Name: `")[1:]]
    return {"reviews": [finding(function_name=n) for n in names], "batch_summary": "done"}


def finding(**changes):
    return {"file_path": "f", "function_name": "g", "line_number": 1, "issue_category": "Bug",
            "severity": "High", "comment": "c", "suggested_fix": "s", "vulnerable_snippet": "v",
            "impact": "i", "confidence_score": 90, "needs_verification": True, **changes}


def test_a_scan_writes_no_code(spark, tmp_path, monkeypatch):
    """Nested definitions repeat their text; what a scan writes stays below what it reads."""
    depth = 12
    body = "".join("    " * i + f"def f{i}():\n" for i in range(depth))
    rows = [("r", f"{i}.py", (body + "    " * depth + f"x = '{i}" + "ab" * 4000 + "'\n").encode())
            for i in range(60)]
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    scan(spark.createDataFrame(rows, FILES)).health.collect()
    written = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    assert 0 < written < sum(len(c) for _, _, c in rows)


def test_scan_with_a_reviewer_of_ones_own(spark, golden):
    result = scan(golden, max_tokens=60, max_batches=3, reviewer=one_per_block)
    assert result.batch_errors.count() == 0
    rows = indexed(result.findings).orderBy("idx").collect()
    assert [r.idx for r in rows] == list(range(len(rows))) and {r.batch_id for r in rows} == {0, 1, 2}
    everything = scan(golden, max_tokens=60, max_batches=None, reviewer=one_per_block)
    assert everything.findings.count() == everything.batches.count() == 12


PROMPT_ROWS = [("r", i, f"prompt {i}") for i in range(12)]


def test_a_failed_batch_does_not_stop_the_others(spark):
    def reviewer(repo, batch_id, prompt):
        if batch_id == 4:
            raise ValueError("no answer")
        if batch_id == 5:
            raise review.RetryableError("slow down")
        return {"reviews": [finding()], "batch_summary": "s"}

    done = review.review_batches(
        spark.createDataFrame(PROMPT_ROWS, PROMPTS), reviewer, wait_seconds=0.01).cache()
    assert {(r.batch_id, r.error) for r in review.batch_errors(done).collect()} == {
        (4, "ValueError: no answer"), (5, "gave up after 3 attempts")}
    assert review.parse_reports(done)[0].count() == 10
    assert {r.batch_id for r in review.pending(
        spark.createDataFrame(PROMPT_ROWS, PROMPTS), done).collect()} == {4, 5}
    row = review.review_progress(spark.createDataFrame(PROMPT_ROWS, PROMPTS), done).first()
    assert (row.done, row.total, row.ratio) == (10, 12, 10 / 12)


def test_a_retryable_failure_is_tried_again(spark, tmp_path):
    folder = str(tmp_path)

    def reviewer(repo, batch_id, prompt):
        mark = os.path.join(folder, str(batch_id))
        if not os.path.exists(mark):
            open(mark, "w").close()
            raise review.RetryableError("once")
        return {"reviews": [], "batch_summary": "s"}

    done = review.review_batches(
        spark.createDataFrame(PROMPT_ROWS, PROMPTS), reviewer, wait_seconds=0.01)
    assert done.filter("error IS NOT NULL").count() == 0


def test_reports_are_checked(spark):
    reports = [
        {"reviews": [finding(confidence_score=150), finding(confidence_score=-5)], "batch_summary": "a"},
        {"reviews": [finding(severity="Severe"), finding(issue_category=None), finding()],
         "batch_summary": "b"},
        {"reviews": [], "batch_summary": "c"},
    ]
    texts = [json.dumps(r) for r in reports] + ["{oops", json.dumps(
        {"reviews": [finding(line_number="many")], "batch_summary": "d"})]
    df = spark.createDataFrame([("r", i, t) for i, t in enumerate(texts)],
                               "repo string, batch_id long, report string")
    findings, summaries, rejects = review.parse_reports(df)
    got = {(r.batch_id, r.pos): (r.confidence_score, r.needs_verification) for r in findings.collect()}
    assert got == {(0, 0): (100, False), (0, 1): (0, True), (1, 2): (90, False)}
    assert {(s.batch_id, s.batch_summary) for s in summaries.collect()} == {(0, "a"), (1, "b"), (2, "c")}
    assert {(r.batch_id, r.pos, r.reason) for r in rejects.collect()} == {
        (1, 0, "unknown severity"), (1, 1, "issue_category is missing"),
        (3, None, "malformed report"), (4, None, "malformed report")}


def test_stream_resumes_and_retries(spark):
    prompts, out = fresh_path(spark, "prompts"), fresh_path(spark, "out")

    def flaky(repo, batch_id, prompt):
        if batch_id % 5 == 2:
            raise RuntimeError("no")
        return {"reviews": [finding(line_number=batch_id)], "batch_summary": ""}

    def steady(repo, batch_id, prompt):
        return {"reviews": [finding(line_number=batch_id)], "batch_summary": ""}

    def run():
        query = review_stream(spark, prompts, out, f"{out}-checkpoint", flaky)
        query.awaitTermination()
        return sum(p["numInputRows"] for p in query.recentProgress)

    spark.createDataFrame(PROMPT_ROWS[:7], PROMPTS).write.parquet(prompts)
    assert run() == 7
    assert run() == 0
    spark.createDataFrame(PROMPT_ROWS[7:], PROMPTS).write.mode("append").parquet(prompts)
    assert run() == 5
    assert read_reviewed(spark, out).filter("error IS NOT NULL").count() == 2
    for _ in range(2):  # the second time nothing is left
        retry_failed(spark, prompts, out, steady)
    findings = review.parse_reports(read_reviewed(spark, out))[0]
    assert sorted(r.line_number for r in findings.collect()) == list(range(12))


def test_a_backlog_is_taken_in_steps(spark):
    prompts, out = fresh_path(spark, "prompts"), fresh_path(spark, "out")
    spark.createDataFrame(PROMPT_ROWS, PROMPTS).repartition(6).write.parquet(prompts)
    review_stream(spark, prompts, out, f"{out}-checkpoint", one_per_block,
                  files_per_run=2).awaitTermination()
    rows = read_reviewed(spark, out)
    assert rows.count() == 12 and len(glob.glob(f"{out}/run=*")) >= 3


def test_progress_is_observed(spark):
    def reviewer(repo, batch_id, prompt):
        return {"reviews": [], "batch_summary": ""} if batch_id else 1 / 0

    progress = Observation("progress")
    done = review.review_batches(spark.createDataFrame(PROMPT_ROWS, PROMPTS), reviewer)
    observe_progress(done, progress).write.format("noop").mode("overwrite").save()
    assert progress.get == {"done": 11, "failed": 1}
