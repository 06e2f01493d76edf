"""Definitions, blocks, call edges and parse errors out of source files."""

from __future__ import annotations

import ast
import contextlib
import warnings
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.batches import each_row
from ..functions.text import decode_text, has_text
from ..schemas import BLOCK_COLUMNS, DEFINITIONS
from .files import source_files
from .js_blocks import js_definitions
from .positions import number_rows

# Length limit and the markers put behind a cut block.
MAX_CODE_LENGTH = 8000
PYTHON_CUT = "\n    # ... [truncated — function exceeds max length]"
SCRIPT_CUT = "\n// ... [truncated — block exceeds max length]"

_OUTPUT_CHARS = 2 << 20  # text held before a result frame is handed to Spark

_DEFINITIONS = pa.schema([
    ("repo", pa.string()), ("path", pa.string()), ("language", pa.string()),
    ("reviewable", pa.bool_()), ("ord", pa.int32()), ("name", pa.string()), ("type", pa.string()),
    ("line_number", pa.int32()), ("code", pa.string()), ("docstring", pa.string()),
    ("callees", pa.list_(pa.string())), ("error", pa.string()),
])

Extractor = Callable[[str], Iterator[dict[str, Any]]]


def python_definitions(source: str) -> Iterator[dict[str, Any]]:
    """Every def, async def and class of one module, outermost level first."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(source)
    lines = source.encode("utf-8").split(b"\n")
    for node in ast.walk(tree):
        if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            continue
        first, last = node.lineno - 1, node.end_lineno - 1
        segment = lines[first:last + 1]
        segment[-1] = segment[-1][:node.end_col_offset]
        segment[0] = segment[0][node.col_offset:]
        yield {
            "name": node.name,
            "type": type(node).__name__,
            "line_number": node.lineno,
            "code": b"\n".join(segment).decode("utf-8"),
            "docstring": ast.get_docstring(node),
            "callees": None if isinstance(node, ast.ClassDef) else _callees(node),
        }


def _callees(function: ast.AST) -> list[str]:
    targets = (n.func for n in ast.walk(function) if isinstance(n, ast.Call))
    names = (getattr(t, "id", None) or getattr(t, "attr", None) for t in targets
             if isinstance(t, (ast.Name, ast.Attribute)))
    return list(names)


_EXTRACTORS: dict[str, Extractor] = {
    "python": python_definitions,
    "javascript": js_definitions,
    "typescript": js_definitions,
    "tsx": js_definitions,
}
_LANGUAGES = dict(paths.EXTENSION_LANGUAGE)


def register_language(extension: str, language: str, extractor: Extractor) -> None:
    """Add a language: files ending in `extension` go to `extractor(source)`, which yields a
    dict per definition with name, type, line_number, code and optionally docstring."""
    _LANGUAGES[extension] = language
    _EXTRACTORS[language] = extractor


@contextlib.contextmanager
def added_language(extension: str, language: str, extractor: Extractor) -> Iterator[None]:
    """A language for the definitions that are asked for within."""
    before = dict(_LANGUAGES), dict(_EXTRACTORS)
    register_language(extension, language, extractor)
    try:
        yield
    finally:
        for known, old in zip((_LANGUAGES, _EXTRACTORS), before):
            known.clear()
            known.update(old)


def languages() -> dict[str, str]:
    """Suffixes with an extractor, by now, and their languages."""
    return dict(_LANGUAGES)


def extract_definitions(files: DataFrame) -> DataFrame:
    """Parse each file once. One row per definition, or one row with `error` per bad file.

    The output feeds blocks, call edges and errors alike; write it as a table (see
    `session.materialize`) when more than one of them is used.
    """
    sources = source_files(files, _LANGUAGES)
    extractors = dict(_EXTRACTORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for file in each_row(batches):
            source = file.pop("content")
            try:
                found = [{**file, **d, "ord": i}
                         for i, d in enumerate(extractors[file["language"]](source))]
            except Exception as e:  # a bad file costs only itself
                found = [{**file, "error": f"{type(e).__name__}: {e}"}]
            rows += found
            size += sum(len(r.get("code") or "") + len(r.get("docstring") or "") for r in found)
            if size > _OUTPUT_CHARS:
                yield pa.RecordBatch.from_pylist(rows, _DEFINITIONS)
                rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, _DEFINITIONS)

    return sources.mapInArrow(run, DEFINITIONS)


def is_dunder(name: str = "name") -> Column:
    """Double-underscore names other than __init__."""
    col = F.col(name)
    return col.startswith("__") & col.endswith("__") & (col != "__init__")


def is_block() -> Column:
    """Definitions that go to review; False for the rows of files that could not be parsed."""
    hidden = is_dunder() & (F.col("language") == "python")
    return F.coalesce(F.col("error").isNull() & F.col("reviewable") & (F.length("code") > 0)
                      & ~hidden, F.lit(False))


def truncate_code(df: DataFrame, max_len: int = MAX_CODE_LENGTH) -> DataFrame:
    marker = F.when(F.col("language") == "python", PYTHON_CUT).otherwise(SCRIPT_CUT)
    cut = F.concat(F.substring("code", 1, max_len), marker)
    return df.withColumn("code", F.when(F.length("code") > max_len, cut).otherwise(F.col("code")))


def to_blocks(definitions: DataFrame) -> DataFrame:
    """Definitions that go to review, one schema for all languages, with the in-file `ord`.

    Code is whole; a prompt that has to be short gets it through `truncate_code`.
    """
    renamed = definitions.filter(is_block()).withColumnRenamed("path", "file_path")
    return renamed.select(*BLOCK_COLUMNS, "ord")


def parse_errors(definitions: DataFrame) -> DataFrame:
    """Files of the review walk that could not be parsed, with the reason."""
    return definitions.filter(F.col("error").isNotNull() & F.col("reviewable")).select(
        "repo", "path", "language", "error"
    )


def to_calls(definitions: DataFrame) -> DataFrame:
    """One row per Python function with its callees, in the wider call-graph walk."""
    return definitions.filter(F.col("callees").isNotNull()).select(
        "repo", "path", "ord", F.col("name").alias("caller"), "callees"
    )


def union_blocks(python: DataFrame, script: DataFrame) -> DataFrame:
    return python.unionByName(script)


def order_blocks(blocks: DataFrame) -> DataFrame:
    """Replace the in-file `ord` by the position in the repository: Python files first, then
    the others, each by path."""
    grouped = blocks.withColumn("_script", (F.col("language") != "python").cast("int"))
    return (
        number_rows(grouped, ["repo"], ["_script", "file_path"], "ord", "_position")
        .drop("ord", "_script").withColumnRenamed("_position", "ord")
    )


def extraction_stats(files: DataFrame, definitions: DataFrame) -> DataFrame:
    """Per repo of `files`: Python files found and parsed, blocks extracted (all languages)."""
    found = _python_files(files).groupBy("repo").agg(
        F.count_if("_python").alias("python_files"),
        F.count_if("_has_text").alias("python_with_text"),
    )
    failed = (
        parse_errors(definitions).filter(F.col("language") == "python")
        .groupBy("repo").agg(F.count("*").alias("failed"))
    )
    blocks = to_blocks(definitions).groupBy("repo").agg(F.count("*").alias("blocks"))
    zero = F.lit(0)
    return (
        found.join(failed, "repo", "left").join(blocks, "repo", "left").select(
            "repo",
            "python_files",
            (F.col("python_with_text") - F.coalesce("failed", zero)).alias("python_parsed"),
            F.coalesce("blocks", zero).alias("blocks"),
        )
    )


def _python_files(files: DataFrame) -> DataFrame:
    """All files, with flags for Python files of the review walk and those that hold any text."""
    python = paths.kept_folder(F.col("path"), "review") & F.col("path").endswith(".py")
    text = F.when(python, has_text(decode_text(F.col("content")))).otherwise(False)
    return files.select("repo", python.alias("_python"), text.alias("_has_text"))
