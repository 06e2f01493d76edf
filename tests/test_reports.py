from __future__ import annotations

import os
import datetime as dt
import glob
import hashlib
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from reviewlake.operators import findings as fo
from reviewlake.operators import health as ho
from reviewlake.operators import history as hist
from reviewlake.operators import pull_requests as pr
from reviewlake.plans import report_queries
from reviewlake.schemas import FINDING_COLUMNS, HISTORY, SEVERITIES
from reviewlake.session import fresh_path
from reviewlake.sinks import reports
from reviewlake.sources.repo_meta import parse_repo_meta
from reviewlake.sources.tree import read_tree
from sessions import conf

BASE = {"repo": "r", "file_path": "shop/cart.py", "function_name": "total_of", "line_number": 42,
        "issue_category": "Performance", "severity": "High", "comment": "c", "suggested_fix": "f",
        "vulnerable_snippet": "rows += query(row.id)", "impact": "i", "confidence_score": 85,
        "needs_verification": False}
KEY = "shop/cart.py_total_of_42"
OTHER = "shop/cart.py_price_42"
SCHEMA = ("repo string, idx long, file_path string, function_name string, line_number int, "
          "issue_category string, severity string, comment string, suggested_fix string, "
          "vulnerable_snippet string, impact string, confidence_score int, "
          "needs_verification boolean")


def make(spark, *changes: dict):
    rows = [{**BASE, "idx": i, **c} for i, c in enumerate(changes)]
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    df = spark.createDataFrame([[r[n] for n in names] for r in rows], SCHEMA)
    return fo.normalize_findings(df)


def test_confidence_is_clamped_and_the_flag_follows(spark):
    """Random scores and the edges of both rules, under every severity, whatever the flag said."""
    rng = random.Random(11)
    scores = [rng.randrange(-200, 300) for _ in range(60)] + [-1, 0, 1, 79, 80, 81, 99, 100, 101]
    given = [{"confidence_score": n, "severity": severity, "needs_verification": rng.random() < 0.5}
             for n in scores for severity in SEVERITIES]
    rows = make(spark, *given).orderBy("idx").collect()
    for g, r in zip(given, rows, strict=True):
        kept = sorted((0, g["confidence_score"], 100))[1]
        assert (r.confidence_score, r.needs_verification) == (kept, kept < 80)


def test_score_without_findings_is_full(spark):
    repos = spark.createDataFrame([("clean",), ("clean",)], "repo string")
    clean = ho.health(make(spark), repos=repos).collect()
    assert [tuple(r) for r in clean] == [("clean", 100, "A", "#22C55E")]
    score = spark.range(1).select(*ho.score_columns(F.lit(None).cast("long"))).first()
    assert (score.score, score.grade, score.color) == (100, "A", "#22C55E")
    empty = fo.kpis(make(spark)).first()
    assert (empty.total, empty.avg_confidence) == (0, "0%")


def score_of(penalty: int) -> tuple[int, str]:
    """Plain form of the rule, in exact hundredths."""
    raw = 100 - min(penalty, 10000) / 100
    grade = next((g for floor, g in ((90, "A"), (75, "B"), (60, "C"), (40, "D")) if raw >= floor), "F")
    return round(raw), grade


def test_scores_grades_and_halves(spark):
    penalties = list(range(0, 10400, 50)) + [1040, 1050, 1049, 12000]
    df = spark.createDataFrame([(p,) for p in penalties], "p long")
    rows = df.select("p", *ho.score_columns(F.col("p"))).collect()
    assert [(r.score, r.grade) for r in rows] == [score_of(r.p) for r in rows]
    rounded = df.filter("p = 1040").select(*ho.score_columns(F.col("p"), "rounded")).first()
    assert (rounded.score, rounded.grade) == (90, "A")  # 89.6: B unrounded


def test_false_positives_carry_no_penalty(spark):
    found = make(spark, {"severity": "Critical", "confidence_score": 100},
                 {"severity": "Critical", "confidence_score": 100, "function_name": "price"},
                 {"repo": "q", "severity": "High"})
    feedback = spark.createDataFrame(
        [("r", KEY, "confirmed", 1), ("r", KEY, "false_positive", 2),
         ("r", OTHER, "false_positive", 1), ("r", OTHER, "confirmed", 2),
         ("q", KEY, "false_positive", 1)],
        "repo string, finding_key string, verdict string, ts int")
    latest = ho.latest_feedback(feedback)
    assert {h.repo: h.score for h in ho.health(found, latest).collect()} == {"r": 75, "q": 100}
    assert {h.repo: h.score for h in ho.health(found).collect()} == {"r": 50, "q": 92}
    assert [r.idx for r in ho.drop_false_positives(found, latest).collect()] == [1]


def test_report_csv_equals_pandas(spark):
    found = make(spark, {}, {"comment": 'say "hi", then\nleave'}, {"comment": " padded ", "impact": ""},
                 {"confidence_score": 10, "comment": "é — ⚠️ \\ back"}).coalesce(1)
    path = fresh_path(spark, "csv")
    reports.write_report_csv(found, path)
    [part] = glob.glob(f"{path}/part-*")
    rows = [r.asDict() for r in found.orderBy("idx").collect()]
    wanted = pd.DataFrame(rows)[list(FINDING_COLUMNS)].to_csv(index=False)
    assert open(part, encoding="utf-8", newline="").read() == wanted


def test_web_csv_quotes_every_cell(spark):
    found = make(spark, {"comment": 'a "b"'}, {"comment": None, "confidence_score": 5})
    path = fresh_path(spark, "web")
    reports.write_web_csv(found.coalesce(1), path)
    text = "".join(open(p).read() for p in sorted(glob.glob(f"{path}/part-*")))
    assert text == (
        "file_path,function_name,line_number,issue_category,severity,comment,suggested_fix,"
        "confidence_score,needs_verification\n"
        '"shop/cart.py","total_of","42","Performance","High","a ""b""","f","85","false"\n'
        '"shop/cart.py","total_of","42","Performance","High","null","f","5","true"\n')


def golden(rows: list) -> bytes:
    """The short report as one text: a bare header, quoted cells, no newline at the end."""
    def cell(value) -> str:
        text = "null" if value is None else str(value).lower() if value in (True, False) and \
            isinstance(value, bool) else str(value)
        return '"' + text.replace('"', '""') + '"'

    lines = [",".join(reports.WEB_COLUMNS)]
    lines += [",".join(cell(r[c]) for c in reports.WEB_COLUMNS) for r in rows]
    return "\n".join(lines).encode()


@pytest.mark.parametrize("parts", [1, 7, 50])
@pytest.mark.parametrize("n", [0, 1, 300])
def test_web_csv_as_one_file(spark, tmp_path, parts, n):
    found = make(spark, *[{"comment": "é\n" * (i % 5) + f'"{i}"', "line_number": i * 7 % n}
                          for i in range(n)]).repartition(parts)
    rows = found.orderBy("line_number", "idx").collect()
    path = tmp_path / "out" / "report.csv"
    for _ in range(2):  # a report written again replaces the file
        reports.write_web_csv_file(found, f"file:{path}", ["line_number", "idx"], parts=parts)
        assert path.read_bytes() == golden(rows)
    assert os.listdir(path.parent) == ["report.csv"]


@pytest.mark.parametrize("parts", [1, 50])
def test_report_csv_as_one_file(spark, tmp_path, parts):
    texts = ["plain", 'say "hi", then\nleave', " padded ", "", None, "é — \\ back", "a,b", "c\rd"]
    found = make(spark, *[{"comment": texts[i % 8], "impact": texts[i // 8 % 8]}
                          for i in range(100)])
    path = tmp_path / "report.csv"
    reports.write_report_csv_file(found.repartition(9), str(path), ["idx"], parts=parts)
    rows = [r.asDict() for r in found.orderBy("idx").collect()]
    wanted = pd.DataFrame(rows)[list(FINDING_COLUMNS)].to_csv(index=False)
    assert path.read_bytes().decode() == wanted


def test_the_digest_of_a_file_takes_any_length(spark, tmp_path):
    path, text = tmp_path / "r.csv", b"0123456789abcdef" * 100_000
    path.write_bytes(text)
    with conf(spark, spark__sql__sources__binaryFile__maxLength=1 << 20):
        for name in (str(path), f"file:{path}"):
            found = report_queries._file_digest(spark, name).collect()
            assert [tuple(r) for r in found] == [(len(text), hashlib.md5(text).hexdigest())]


def test_a_report_that_fails_leaves_the_file(spark, tmp_path):
    path = tmp_path / "report.csv"
    reports.write_web_csv_file(make(spark, {}), str(path), ["idx"])
    before = path.read_bytes()
    broken = make(spark, {}, {}).withColumn("comment", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception):
        reports.write_web_csv_file(broken, str(path), ["idx"])
    assert path.read_bytes() == before and os.listdir(tmp_path) == ["report.csv"]
    with pytest.raises(ValueError):
        reports.write_web_csv_file(make(spark, {}), "hdfs://h/report.csv", ["idx"])


def test_responses_page_by_position(spark):
    found = make(spark, *[{} for _ in range(5)])
    targets = spark.createDataFrame([("r", "u/r"), ("none", "u/none")], "repo string, repo_url string")
    rows = {(r.repo_url, r.page): r for r in reports.scan_responses(targets, found, page=2).collect()}
    assert sorted(rows) == [("u/none", 0), ("u/r", 0), ("u/r", 1), ("u/r", 2)]
    assert [len(json.loads(rows["u/r", p].findings)) for p in range(3)] == [2, 2, 1]
    none = rows["u/none", 0]
    assert (none.total_findings, none.health_score, none.findings) == (0, 100, "[]")
    assert json.loads(rows["u/r", 0].findings)[0] == {
        c: BASE[c] for c in FINDING_COLUMNS}


def test_history_keeps_scans_without_findings(spark):
    path = fresh_path(spark, "history")
    repos = spark.createDataFrame([("r",), ("none",)], "repo string")
    for day in (1, 2):
        when = F.to_timestamp(F.lit(f"2024-01-0{day} 00:00:00"))
        for _ in range(2):  # a scan written again under its id counts once
            reports.append_history(make(spark, {"severity": "Critical"}, {}), path, when, repos,
                                   f"scan-{day}")
    rows = reports.read_history(spark, path)
    assert {(r.repo, r.findings, r.critical) for r in rows.collect()} == {("r", 2, 1), ("none", 0, 0)}
    assert rows.count() == 4


@pytest.mark.parametrize("scans,wanted", [
    ([("a", 9), ("a", 4)], ("improving", "↓", 5, "5 findings fewer than last scan")),
    ([("a", 4), ("a", 9)], ("degrading", "↑", -5, "5 findings more than last scan")),
    ([("a", 4), ("a", 4)], ("stable", "→", 0, "0 findings more than last scan")),
    ([("a", 9), ("b", 4)], None), ([("a", 9)], None),
    ([("a", 1), ("b", 9), ("b", 8)], ("improving", "↓", 1, "1 findings fewer than last scan"))])
def test_trend(spark, scans, wanted):
    start = dt.datetime(2024, 1, 1)
    history = spark.createDataFrame(
        [(r, n, 0, start + dt.timedelta(hours=i)) for i, (r, n) in enumerate(scans)], HISTORY)
    row = hist.trend(history).first()
    assert (row and (row.trend, row.symbol, row.delta, row.text)) == wanted
    assert hist.recent_scans(history, 1).first().findings == scans[-1][1]


def test_pr_plan_caps_before_the_file_test(spark):
    found = make(spark, {"severity": "Low", "file_path": "in.py"}, {"severity": "Critical"},
                 {"severity": "Odd", "file_path": "in.py"},
                 {"severity": "High", "file_path": "in.py", "confidence_score": 50})
    changed = spark.createDataFrame([("r", "in.py", "abc"), ("r", "in.py", "abc")],
                                    "repo string, file_path string, commit_id string")
    plan = pr.plan_pr_comments(found, changed, 3).orderBy("position").collect()
    assert [(p.idx, p.status, p.side) for p in plan] == [
        (1, "skipped", "RIGHT"), (3, "planned", "RIGHT"), (0, "planned", "RIGHT")]
    assert plan[1].body == (
        "**[AI Code Review] Performance — High Severity**\n\nc\n\n**Suggested fix:** f\n\n"
        "*Confidence: 50% — ⚠️ Verify before acting*") and plan[1].commit_id == "abc"
    assert plan[2].body.endswith("*Confidence: 85%*")
    outcome = pr.pr_outcome(pr.plan_pr_comments(found, changed, 3)).first()
    assert (outcome.posted, outcome.skipped, outcome.failed) == (2, 1, 0)


def test_repo_meta_defaults(spark):
    texts = ['{"size":5,"language":null,"default_branch":"dev"}', "{}", "{broken", None,
             '{"size":null,"description":"d","stargazers_count":3,"language":"Go"}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, json string")
    rows = [tuple(r)[1:] for r in parse_repo_meta(df).orderBy("i").collect()]
    assert rows == [
        (5, 0, None, "", "dev"), (0, 0, "Unknown", "", "main"), (0, 0, None, "", "main"),
        (0, 0, None, "", "main"), (None, 3, "Go", "d", "main")]


def test_tree_scan_keeps_underscore_and_dot_files(spark, tmp_path):
    for path in ("__init__.py", ".hidden.py", "a/b/c/_d.py", "a/x.js", "a/note.md", ".git/h.py",
                 "venv/v.py", "node_modules/n.js", "z/y/w.tsx"):
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(path.encode())
    wanted = {"__init__.py", ".hidden.py", "a/b/c/_d.py", "a/x.js", "node_modules/n.js", "z/y/w.tsx"}
    (tmp_path / "broken.py").symlink_to(tmp_path / "nowhere.py")
    os.mkfifo(tmp_path / "pipe.py")
    for split_bytes in (4, 1 << 20):
        rows = read_tree(spark, str(tmp_path), "r", split_bytes=split_bytes).collect()
        assert [r.path for r in rows if r.content is None] == ["broken.py"]
        rows = [r for r in rows if r.content is not None]
        assert {r.path for r in rows} == wanted and len(rows) == len(wanted)
        assert all(bytes(r.content) == r.path.encode() and r.repo == "r" for r in rows)
    assert read_tree(spark, str(tmp_path), "r", suffixes=()).count() == len(wanted) + 2
    empty = tmp_path / "empty"
    empty.mkdir()
    assert read_tree(spark, str(empty), "r").count() == 0
