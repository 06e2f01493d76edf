from __future__ import annotations

import ast
import textwrap
import time

import pytest
from pyspark.sql import functions as F

from reviewlake.operators import call_graph, extract
from reviewlake.operators.js_blocks import js_definitions
from reviewlake.operators.prompts import build_prompts
from reviewlake.schemas import FILES

SIMPLE = '''
def greet(name):
    """Say hello.

       Twice.
    """
    return f"Hello, {name}"


class Calculator:
    def add(self, a, b):
        return a + b

    @staticmethod
    def divide(a, b):
        if b == 0:
            raise ZeroDivisionError("no")
        return a / b

    def __init__(self):
        self.x = lambda: helper(1)

    def __repr__(self):
        return "é" + str(self.add(1, 2))


async def late():
    def inner():
        deep()
    inner()
    mod.inner().outer(call()())
'''
SCRIPT = r'''// function no() {}
import x from "y";
export default async function main<T>(a: {b: string}, c = "}"): Promise<{x: number}> {
  const inner = (q) => q / 2;
  const re = /[{}"']/g, other = async x => { return `a ${x ? `{${x}` : "}"} b`; };
  return a.map(function named(z) { return z; });
}
const f1 = function () { return 1; }, f2 = (a, b) => a
  .foo(b)
let notfn = (1 + 2) * 3;
const h: (x: number) => string = (x) => String(x);
const iife = function () { return 1; }();
const memo = useCallback(() => { doIt(); }, []);
function* gen() { yield 1; }
abstract class Abs { foo(): void; }
const E = class Named { m() { return 1 } }
export class V extends mixin(A, {x: 1}) {
  #priv() { return 1; }
  "str"() { return 2; }
  private readonly y: string = "don't";
  z = () => { return 3; };
  constructor(private a: string) { super(); if (a) { this.go(); } }
  static async load(id: number): Promise<V> { return new V("x"); }
  get val() { return 1; }
  over(a: string): void;
  over(a: any): void { for (const i of a) { i(); } }
  *items() { yield 2; }
}
const obj = { go(x) { return x; }, pair: function (y) { return y; }, arrow: (y) => y };
declare function ambient(a: string): void
function after(a) { return <p>Don't {a}</p>; }
if (x) { function blockFn() {} }
export const Comp = ({ a, b }: Props): JSX.Element => {
  return <div className="x">it's {a}</div>;
};
var last = x => x + 1
'''
SCRIPT_DEFINITIONS = [
    (3, "function", "main"), (4, "function", "inner"), (5, "function", "other"),
    (8, "function", "f1"), (8, "function", "f2"), (11, "function", "h"), (16, "method", "m"),
    (17, "class", "V"), (22, "method", "constructor"), (23, "method", "load"), (24, "method", "val"),
    (26, "method", "over"), (27, "method", "items"), (29, "method", "go"), (31, "function", "after"),
    (32, "function", "blockFn"), (33, "function", "Comp"), (36, "function", "last"),
]


def files(spark, **content: str | bytes):
    rows = [("r", path.replace("__", "/").replace("_DOT_", "."),
             c if isinstance(c, bytes) else c.encode()) for path, c in content.items()]
    return spark.createDataFrame(rows, FILES)


def names(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("repo", "file_path", "ord").collect()]


def test_python_definitions_equal_the_ast_module():
    found = list(extract.python_definitions(SIMPLE))
    tree = ast.parse(SIMPLE)
    nodes = [n for n in ast.walk(tree)
             if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
    assert [(f["name"], f["type"], f["line_number"], f["code"], f["docstring"]) for f in found] == [
        (n.name, type(n).__name__, n.lineno, ast.get_source_segment(SIMPLE, n),
         ast.get_docstring(n)) for n in nodes]
    calls = {f["name"]: f["callees"] for f in found}
    assert calls["divide"] == ["ZeroDivisionError"] and calls["inner"] == ["deep"]
    assert calls["Calculator"] is None and calls["__init__"] == ["helper"]
    assert sorted(calls["late"]) == ["call", "deep", "inner", "inner", "outer"]


def test_blocks_of_a_module(spark):
    found = extract.to_blocks(extract.extract_definitions(files(spark, a_DOT_py=SIMPLE)))
    assert names(found, "name", "type") == [
        ("greet", "FunctionDef"), ("Calculator", "ClassDef"), ("late", "AsyncFunctionDef"),
        ("add", "FunctionDef"), ("divide", "FunctionDef"), ("__init__", "FunctionDef"),
        ("inner", "FunctionDef")]
    rows = {r.name: r for r in found.collect()}
    assert rows["greet"].docstring == "Say hello.\n\nTwice." and rows["greet"].line_number == 2
    assert rows["divide"].code.startswith("def divide")  # decorators stay outside
    assert rows["late"].docstring is None and rows["late"].language == "python"


@pytest.mark.parametrize("content,kind", [
    ("def broken(\n    # never closed", "SyntaxError"), ("\ufeffdef f(): pass", "SyntaxError"),
    ("def f():\n\tpass\n        pass", "TabError"), ("x = 1\0", "SyntaxError")])
def test_a_bad_file_costs_only_itself(spark, content, kind):
    df = extract.extract_definitions(files(spark, bad_DOT_py=content, ok_DOT_py="def f(): pass"))
    errors = extract.parse_errors(df).collect()
    assert [(e.path, e.error.split(":")[0]) for e in errors] == [("bad.py", kind)]
    assert names(extract.to_blocks(df), "file_path", "name") == [("ok.py", "f")]


def test_blank_unsupported_and_ignored_files_give_nothing(spark):
    df = files(spark, a_DOT_py=" \n\x1f", b_DOT_md="def f(): pass", empty_DOT_js="",
               node_modules__c_DOT_py="def kept_for_calls(): g()", node_modules__d_DOT_js="function x() {}")
    found = extract.extract_definitions(df)
    assert extract.to_blocks(found).count() == 0 and extract.parse_errors(found).count() == 0
    assert [(r.caller, r.callees) for r in extract.to_calls(found).collect()] == [
        ("kept_for_calls", ["g"])]


def test_bytes_are_decoded_and_line_ends_translated(spark):
    df = files(spark, a_DOT_py=b"# caf\xe9\r\ndef f():\r    return 1\r\n")
    block = extract.to_blocks(extract.extract_definitions(df)).first()
    assert (block.line_number, block.code) == (2, "def f():\n    return 1")


def test_long_code_is_cut_with_the_marker_of_its_language(spark):
    body = "x" * 9000
    df = files(spark, a_DOT_py=f'def f():\n    "{body}"\n', b_DOT_ts=f'function g() {{ "{body}" }}')
    whole = extract.to_blocks(extract.extract_definitions(df))
    assert {r.name: len(r.code) for r in whole.collect()} == {"f": 9015, "g": 9019}
    rows = {r.name: r.code for r in extract.truncate_code(whole).collect()}
    assert rows["f"] == f'def f():\n    "{body}'[:8000] + extract.PYTHON_CUT
    assert rows["g"] == f'function g() {{ "{body}'[:8000] + extract.SCRIPT_CUT


def test_script_definitions():
    found = list(js_definitions(SCRIPT))
    assert [(f["line_number"], f["type"], f["name"]) for f in found] == SCRIPT_DEFINITIONS
    code = {f["name"]: f["code"] for f in found}
    assert code["f2"] == "f2 = (a, b) => a\n  .foo(b)" and code["last"] == "last = x => x + 1"
    assert code["main"].startswith("async function main") and code["main"].endswith("});\n}")
    assert code["val"] == "get val() { return 1; }"
    assert code["load"].startswith("static async load") and code["Comp"].endswith("</div>;\n}")


def test_comments_of_any_length_hide_nothing():
    note = "/*" + "x" * 500 + "*/"
    found = [(d["name"], d["type"]) for d in js_definitions(
        f"const {note} h = (x) => 1;\nconst k = {note} class Foo {{ a() {{}} }};\n"
        f"let q = b {note} / 2; function g() {{ return 1 / 2; }}\n"
        f"function r() {{ return {note} /[{{'\"]/.test(y); }}\nfunction s() {{}}")]
    assert found == [("h", "function"), ("a", "method"), ("g", "function"), ("r", "function"),
                     ("s", "function")]


def test_a_long_list_of_declarators_takes_linear_time():
    source = "var " + ",\n ".join(f"f{i} = function () {{ return {i}; }}" for i in range(20_000))
    began = time.process_time()
    found = list(js_definitions(source + ";"))
    assert [d["line_number"] for d in found] == list(range(1, 20_001))
    assert time.process_time() - began < 5


def test_script_blocks_carry_their_language(spark):
    source = "function a() {}\nclass B { c() {} }\n"
    df = files(spark, a_DOT_js=source, b_DOT_ts=source, c_DOT_tsx=source, d_DOT_py="def p(): pass")
    found = extract.order_blocks(extract.to_blocks(extract.extract_definitions(df)))
    assert [(r.ord, r.language, r.name) for r in found.orderBy("ord").collect()] == [
        (i, *x) for i, x in enumerate([("python", "p")] + [
            (lang, n) for lang in ("javascript", "typescript", "tsx") for n in ("a", "B", "c")])]


def test_a_language_can_be_added(spark):
    def sql_definitions(source):
        for i, line in enumerate(source.splitlines()):
            if line.startswith("CREATE FUNCTION "):
                yield {"name": line.split()[2], "type": "function", "line_number": i + 1, "code": line}

    extract.register_language(".sql", "sql", sql_definitions)
    try:
        df = files(spark, a_DOT_sql="-- x\nCREATE FUNCTION f AS 1", b_DOT_py="def g(): pass")
        found = extract.to_blocks(extract.extract_definitions(df))
        assert names(found, "language", "name", "line_number") == [("sql", "f", 2), ("python", "g", 1)]
    finally:
        del extract._LANGUAGES[".sql"], extract._EXTRACTORS["sql"]


def test_call_graph_by_name(spark):
    a = "def load(): first()\ndef main():\n    load(); load()\nclass K:\n    def load(self): second()\n"
    b = "def other():\n    load(); main()\n"
    df = extract.extract_definitions(files(spark, a_DOT_py=a, b_DOT_py=b))
    graph = call_graph.latest_calls(extract.to_calls(df))
    calls = {r.caller: (r.callees, r["first"].path, r["first"].ord) for r in graph.collect()}
    assert calls["load"] == (["second"], "a.py", 0)  # last definition, place of the first
    context = {r.name: (r.callers, r.callees) for r in call_graph.call_context(graph).collect()}
    assert context == {"load": (["main", "other"], ["second"]), "main": (["other"], ["load", "load"]),
                       "other": ([], ["load", "main"])}
    blocks = call_graph.with_call_context(extract.to_blocks(df), graph)
    assert {r.name for r in blocks.collect() if r.callers is None} == {"K"}


def test_call_context_is_cut_in_graph_order(spark):
    source = "\n".join(f"def c{i:02}(): hot()" for i in range(9)) + "\ndef hot():\n    " + "; ".join(
        f"d{i}()" for i in range(14))
    df = extract.extract_definitions(files(spark, a_DOT_py=source))
    hot = call_graph.call_context(call_graph.latest_calls(extract.to_calls(df))).filter(
        "name = 'hot'").first()
    assert hot.callers == [f"c{i:02}" for i in range(5)]
    assert hot.callees == [f"d{i}" for i in range(10)]


def test_prompt(spark):
    code = textwrap.dedent('''
        def f():
            """Doc."""
            token = "0123456789012345678901234"
            g()

        def g(): pass
        ''')
    df = extract.extract_definitions(files(spark, a_DOT_py=code))
    batches = extract.order_blocks(extract.to_blocks(df)).withColumn("batch_id", F.lit(0))
    graph = call_graph.latest_calls(extract.to_calls(df))
    assert build_prompts(batches, graph).first().prompt == (
        "\n---\nFile: `a.py` | Language: python | Line: 2 | Type: FunctionDef | Name: `f`\n"
        "Docstring: Doc.\nCalls: g\n"
        '```python\ndef f():\n    """Doc."""\n    token=[REDACTED]\n    g()\n```\n'
        "\n---\nFile: `a.py` | Language: python | Line: 7 | Type: FunctionDef | Name: `g`\n"
        "Called by: f\n```python\ndef g(): pass\n```\n")
