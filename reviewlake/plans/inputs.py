"""Inputs derived from the test tables, as SQL both Spark and DuckDB can run.

The tables hold no source code and no findings, so both are derived from them: findings from
`orders`, scan history and metadata from `events`, addresses from `customer`, files, blocks and
calls from `documents`. In file bodies ~ stands for a newline, @ for the document id and ^ for the document's
whole text, with characters that could end a string or comment replaced by spaces.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from ..functions.cwe import CWE_KEYWORDS

TABLES = ("benchmark", "conversations", "customer", "documents", "events", "orders", "pages")

# Extension and body of each kind of test file.
TEMPLATES = (
    (".py", "def f@(a, b):~    \"\"\"D^.\"\"\"~    return a / b~"),
    (".py", "import pickle~~class C@:~    def load(self, d):~        # ^~        return pickle.loads(d)~"
            "    def __repr__(self):~        return \"x\"~    def __init__(self):~"
            "        self.k = helper@(1)~~def helper@(x):~    return load(x)~"),
    (".py", "async def q@(conn, email):~"
            "    q = \"SELECT * FROM users WHERE email = '\" + email + \"'\"  # ^~"
            "    return conn.execute(q)~"),
    (".py", "def broken@(~"),
    (".js", "// ^~function g@(u) {~  c.innerHTML = u;~}~const h@ = (x) => { return g@(x); };~"),
    (".mjs", "class K@ {~  t = '^';~  run(db, m) { return db.query(`SELECT * FROM users WHERE "
             "e='${m}'`); }~}~"),
    (".tsx", "export class V@ {~  check(e: string): boolean { /* ^ */ return e.includes(\"x\"); }~}~"),
    (".py", "  ~ ~"),
    (".md", "def not_code@(): pass~"),
)
# The definitions in them: template, order, name, type, line, code, language.
EXPECTED = (
    (0, 0, "f@", "FunctionDef", 1, "def f@(a, b):~    \"\"\"D^.\"\"\"~    return a / b", "python"),
    (1, 0, "C@", "ClassDef", 3,
     "class C@:~    def load(self, d):~        # ^~        return pickle.loads(d)~"
     "    def __repr__(self):~        return \"x\"~    def __init__(self):~"
     "        self.k = helper@(1)", "python"),
    (1, 1, "helper@", "FunctionDef", 12, "def helper@(x):~    return load(x)", "python"),
    (1, 2, "load", "FunctionDef", 4,
     "def load(self, d):~        # ^~        return pickle.loads(d)", "python"),
    (1, 4, "__init__", "FunctionDef", 9,
     "def __init__(self):~        self.k = helper@(1)", "python"),
    (2, 0, "q@", "AsyncFunctionDef", 1,
     "async def q@(conn, email):~    q = \"SELECT * FROM users WHERE email = '\" + email + "
     "\"'\"  # ^~    return conn.execute(q)", "python"),
    (4, 0, "g@", "function", 2, "function g@(u) {~  c.innerHTML = u;~}", "javascript"),
    (4, 1, "h@", "function", 5, "h@ = (x) => { return g@(x); }", "javascript"),
    (5, 0, "K@", "class", 1,
     "class K@ {~  t = '^';~  run(db, m) { return db.query(`SELECT * FROM users WHERE e='${m}'`); }~}",
     "javascript"),
    (5, 1, "run", "method", 3,
     "run(db, m) { return db.query(`SELECT * FROM users WHERE e='${m}'`); }", "javascript"),
    (6, 0, "V@", "class", 1,
     "class V@ {~  check(e: string): boolean { /* ^ */ return e.includes(\"x\"); }~}", "tsx"),
    (6, 1, "check", "method", 2,
     "check(e: string): boolean { /* ^ */ return e.includes(\"x\"); }", "tsx"),
)
# The calls in them: template, order, caller, callees joined by a comma.
EXPECTED_CALLS = (
    (0, 0, "f@", ""),
    (1, 1, "helper@", "load"),
    (1, 2, "load", "loads"),
    (1, 3, "__repr__", ""),
    (1, 4, "__init__", "helper@"),
    (2, 0, "q@", "execute"),
)
# Lines that rules hit; the second finds a rule twice on a line, which counts once.
RULE_HITS = tuple((i, *hit) for i, hit in enumerate((
    ("python", "    return a / b"), ("python", "x = pickle.loads(d) or pickle.loads(e)"),
    ("python", "os.system(cmd)  # run"), ("python", 'q = f"select {x}"'),
    ("javascript", "exec(cmd)"), ("javascript", "el.innerHTML = value;"),
    ("typescript", "const o = _.merge(target, source);"), ("tsx", "eval(text)"),
    ("javascript", "const v = unserialize(data);"), ("tsx", "target[key] = value;"),
)))
EXTRA_PHRASES = (
    "Evaluate XSS and sql injection", "was executed slowly", "prototype pollution", "looks fine",
)


def _literal(value) -> str:
    """Spark substitutes ${...} in query text, so a dollar sign is spelled out."""
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("'", "''").replace("$", "' || chr(36) || '") + "'"


def values(rows, columns: str) -> str:
    lines = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {lines}) AS t({columns})"


def _filled(col: str) -> str:
    return (f"replace(replace(replace({col}, '~', chr(10)), '@', CAST(doc_id AS STRING)), "
            "'^', clean)")


# Characters of a text that would end a string or comment it is put in.
_ENDING = "concat(chr(9), chr(10), chr(13), chr(34), chr(36), chr(39), chr(92), chr(96), '*/~@^=<>')"


@cache
def views() -> dict[str, str]:
    """Name to query; a query may use tables and the names before it."""
    phrases = [f"Found {k} here" for k, _ in CWE_KEYWORDS] + list(EXTRA_PHRASES)
    return {
        "phrases_v": values(list(enumerate(phrases)), "i, phrase"),
        "raw_findings_v": """
            SELECT o_orderkey AS idx, concat('repo_', o_custkey) AS repo,
              concat('src/p', o_orderkey % 13, '/f', o_orderkey % 29, '.py') AS file_path,
              concat('fn_', o_orderkey % 97) AS function_name,
              CAST(o_orderkey % 400 + 1 AS INT) AS line_number,
              CASE o_orderkey % 6 WHEN 0 THEN 'Security' WHEN 1 THEN 'Performance'
                WHEN 2 THEN 'Bug' WHEN 3 THEN 'Style' WHEN 4 THEN 'Maintainability'
                ELSE 'Documentation' END AS issue_category,
              CASE o_orderkey % 4 WHEN 0 THEN 'Critical' WHEN 1 THEN 'High'
                WHEN 2 THEN 'Medium' ELSE 'Low' END AS severity,
              p.phrase AS comment, concat('fix ', p.phrase) AS suggested_fix,
              concat('line_', o_orderkey % 50) AS vulnerable_snippet,
              CASE WHEN o_orderkey % 9 = 0 THEN '  ' ELSE 'impact' END AS impact,
              CAST(CAST(floor(o_totalprice) AS BIGINT) % 148 - 15 AS INT) AS raw_confidence
            FROM orders JOIN phrases_v p ON p.i = o_orderkey % 30""",
        # What normalization makes of them; used by the checks only.
        "findings_v": """
            SELECT idx, repo, file_path, function_name, line_number, issue_category, severity,
              comment, suggested_fix, vulnerable_snippet, impact,
              CAST(greatest(0, least(100, raw_confidence)) AS INT) AS confidence_score,
              greatest(0, least(100, raw_confidence)) < 80 AS needs_verification
            FROM raw_findings_v""",
        "feedback_v": """
            SELECT idx, repo, concat_ws('_', file_path, function_name,
                CAST(line_number AS STRING)) AS finding_key, n,
              CASE WHEN (idx + n) % 3 = 0 THEN 'false_positive' ELSE 'confirmed' END AS verdict
            FROM raw_findings_v CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 AS n) w
            WHERE idx % 5 = 0""",
        "pr_files_v": "SELECT repo, file_path FROM raw_findings_v WHERE idx % 3 = 0",
        "history_v": """
            SELECT concat('repo_', user_id) AS repo, CAST(floor(value) AS INT) AS findings,
              CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS INT) AS critical, ts
            FROM events""",
        # Scans of one repo follow each other here.
        "yearly_history_v": """
            SELECT concat('repo_', CAST(year(ts) AS STRING)) AS repo, findings, critical, ts
            FROM history_v""",
        "meta_v": """
            SELECT event_id, CASE event_id % 10 WHEN 0 THEN '{broken'
              WHEN 1 THEN '{"size":5,"language":null}'
              WHEN 2 THEN '{"stargazers_count":7,"language":"Python"}'
              ELSE props END AS json FROM events""",
        "targets_v": """
            SELECT c_custkey, concat('repo_', c_custkey) AS repo,
              concat(CASE c_custkey % 5 WHEN 0 THEN 'https://github.com/o/'
                WHEN 1 THEN ' https://github.com/o/' WHEN 2 THEN 'https://gitlab.com/o/'
                WHEN 3 THEN 'https://github.com/' ELSE 'http://github.com/o/' END, 'r', c_custkey,
                CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '.git' ELSE '/' END) AS repo_url
            FROM customer""",
        "templates_v": values([(i, *t) for i, t in enumerate(TEMPLATES)], "t, ext, body"),
        "files_v": f"""
            SELECT d.source AS repo, doc_id, t,
              concat(CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'src/' WHEN 2 THEN 'lib/sub/'
                WHEN 3 THEN 'node_modules/x/' WHEN 4 THEN '.cache/' WHEN 5 THEN 'build/'
                ELSE 'pkg/' END, 'm', doc_id, ext) AS path, {_filled("body")} AS content, clean
            FROM (SELECT doc_id, source, translate(text, {_ENDING}, repeat(' ', 17)) AS clean
              FROM documents) d JOIN templates_v ON t = doc_id % 9""",
        "expected_v": f"""
            SELECT repo, path, doc_id, f.t, e.ord, {_filled("e.name")} AS name, e.type,
              e.line_number, {_filled("e.code")} AS code, e.language,
              CASE WHEN f.t = 0 THEN concat('D', clean, '.') END AS docstring
            FROM files_v f JOIN ({values(EXPECTED, "t, ord, name, type, line_number, code, language")}) e
              ON e.t = f.t
            WHERE doc_id % 7 NOT IN (3, 4, 5)""",
        "expected_calls_v": f"""
            SELECT repo, path, doc_id, e.ord, {_filled("e.caller")} AS caller,
              {_filled("e.callees")} AS callees
            FROM files_v f JOIN ({values(EXPECTED_CALLS, "t, ord, caller, callees")}) e ON e.t = f.t
            WHERE doc_id % 7 <> 4""",
        "blocks_v": """
            SELECT source AS repo, doc_id AS ord, concat('src/', lang, '/d', doc_id, '.py')
                AS file_path,
              concat('fn_', doc_id % 97) AS name, 'FunctionDef' AS type,
              CAST(doc_id % 500 + 1 AS INT) AS line_number, text AS code,
              CAST(NULL AS STRING) AS docstring, 'python' AS language FROM documents""",
        "calls_v": """
            SELECT source AS repo, doc_id AS ord, concat('fn_', doc_id % 97) AS caller, k AS pos,
              concat('fn_', CASE k WHEN 0 THEN 3 * doc_id % 97 WHEN 1 THEN (5 * doc_id + 1) % 97
                ELSE doc_id % 97 END) AS callee
            FROM documents CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k
              UNION ALL SELECT 2 AS k) s""",
        # What the packing and the call graph make of them; used by the checks only.
        "tokens_v": """
            SELECT repo, ord, CAST(ceil(length(concat(chr(10), 'File: ', file_path, ' | Line: ',
                line_number, ' | Function: ', name, chr(10), '```python', chr(10), code, chr(10),
                '```', chr(10))) / 4.0) AS BIGINT) AS tokens,
              row_number() OVER (PARTITION BY repo ORDER BY ord) AS rn FROM blocks_v""",
        "batches_v": """
            SELECT repo, rn, ord, tokens, CAST(0 AS BIGINT) AS batch_id,
              CASE WHEN tokens > 3000 THEN -1 ELSE tokens END AS held FROM tokens_v WHERE rn = 1
            UNION ALL
            SELECT n.repo, n.rn, n.ord, n.tokens,
              w.batch_id + CASE WHEN w.held < 0 OR w.held + n.tokens > 3000 THEN 1 ELSE 0 END,
              CASE WHEN n.tokens > 3000 THEN -1 WHEN w.held < 0 OR w.held + n.tokens > 3000
                THEN n.tokens ELSE w.held + n.tokens END
            FROM batches_v w JOIN tokens_v n ON n.repo = w.repo AND n.rn = w.rn + 1""",
        "latest_calls_v": """
            SELECT c.repo, c.caller, first_ord, pos, callee FROM calls_v c JOIN (
              SELECT repo, caller, max(ord) AS last_ord, min(ord) AS first_ord FROM calls_v
              GROUP BY repo, caller) l
            ON c.repo = l.repo AND c.caller = l.caller AND c.ord = l.last_ord""",
        "callers_v": """
            SELECT repo, name, string_agg(caller, ', ' ORDER BY first_ord) AS callers FROM (
              SELECT *, row_number() OVER (PARTITION BY repo, name ORDER BY first_ord) AS r FROM (
                SELECT DISTINCT repo, callee AS name, caller, first_ord FROM latest_calls_v) d) e
            WHERE r <= 5 GROUP BY repo, name""",
        "callees_v": """
            SELECT repo, caller AS name, string_agg(callee, ', ' ORDER BY pos) AS callees
            FROM latest_calls_v WHERE pos < 10 GROUP BY repo, caller""",
        # Whole document texts as one Python function each.
        "long_files_v": """
            SELECT source AS repo, doc_id, concat('d', doc_id, '.py') AS path,
              concat('def d', doc_id, '():', chr(10), '    x = \"\"\"',
                replace(replace(text, chr(92), ' '), '\"', ' '), '\"\"\"', chr(10),
                '    return x', chr(10)) AS content FROM documents""",
        # Whole document texts with lines around them that rules hit, some twice.
        "rule_blocks_v": f"""
            SELECT repo, ord, file_path, name, type, line_number, concat(hit, chr(10), code,
                chr(10), hit, chr(10), CASE WHEN ord % 3 = 0 THEN hit ELSE '' END) AS code,
              docstring, h.language FROM blocks_v JOIN (
                {values(RULE_HITS, "i, language, hit")}) h ON i = ord % {len(RULE_HITS)}""",
        # Report texts: two findings each, the second off the domain in every fifth report,
        # every tenth report cut off.
        "reports_v": """
            SELECT repo, idx AS batch_id, CASE WHEN idx % 10 = 3 THEN '{"reviews": [{' ELSE
              concat('{"reviews":[', first, ',', replace(first, severity,
                CASE WHEN idx % 5 = 0 THEN '"Severe"' ELSE '"Low"' END),
                '],"batch_summary":"summary ', idx, '"}') END AS report
            FROM (SELECT repo, idx, concat('"', severity, '"') AS severity, concat(
              '{"file_path":"', file_path, '","function_name":"', function_name,
              '","line_number":', line_number, ',"issue_category":"', issue_category,
              '","severity":"', severity, '","comment":"', comment, '","suggested_fix":"',
              suggested_fix, '","vulnerable_snippet":"', vulnerable_snippet, '","impact":"',
              impact, '","confidence_score":', raw_confidence, ',"needs_verification":true}')
              AS first FROM raw_findings_v) r""",
    }


def _used(text: str) -> set[str]:
    return set(re.findall(r"\b(?:FROM|JOIN) (\w+)", text))


def with_views(query: str) -> str:
    """`query` with the views it uses, directly or through others, in front."""
    known = views()
    needed = _used(query)
    for name in reversed(list(known)):
        if name in needed:
            needed |= _used(known[name])
    ctes = [f"{n} AS ({q})" for n, q in known.items() if n in needed]
    if not ctes:
        return query
    query = query.strip()
    joint = ", " if query.startswith("WITH ") else "\n"
    return f"WITH RECURSIVE {', '.join(ctes)}{joint}{query.removeprefix('WITH ')}"


def read(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A table by name, or a derived view over the tables in `sf_dir`.

    A test table is one file with one row group, which is one task. `spread` deals its rows out,
    for queries bound by CPU.
    """
    text = f"SELECT * FROM {name}"
    if name not in TABLES:
        text = with_views(text).removeprefix("WITH RECURSIVE ")
    tables = []
    for table in TABLES:
        if table in _used(text):
            path = f"{sf_dir}/{table}.parquet"
            cores = spark.sparkContext.defaultParallelism
            hint = f"/*+ REPARTITION({cores}) */" if spread else ""
            tables.append(f"{table} AS (SELECT {hint} * FROM parquet.`{path}`)")
    joint = " " if name in TABLES else ", "
    return spark.sql(f"WITH {', '.join(tables)}{joint}{text}")
