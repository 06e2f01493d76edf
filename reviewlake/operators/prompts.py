"""The text a reviewer gets for each batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import code_fence
from ..functions.secrets import scrub
from .call_graph import with_call_context


def _when_filled(label: str, names: Column) -> Column:
    line = F.concat(F.lit(label), F.array_join(names, ", "), F.lit("\n"))
    return F.when(F.size(names) > 0, line).otherwise("")


def section(with_context: bool) -> Column:
    """One block: a header line, its docstring and call context if any, the fenced code."""
    lang = F.coalesce("language", F.lit("python"))
    docstring = F.concat(F.lit("Docstring: "), F.col("docstring"), F.lit("\n"))
    parts = [
        F.lit("\n---\nFile: `"), F.col("file_path"), F.lit("` | Language: "), lang,
        F.lit(" | Line: "), F.col("line_number").cast("string"), F.lit(" | Type: "),
        F.col("type"), F.lit(" | Name: `"), F.col("name"), F.lit("`\n"),
        F.when(F.length("docstring") > 0, docstring).otherwise(""),
    ]
    if with_context:
        parts += [_when_filled("Called by: ", F.col("callers")),
                  _when_filled("Calls: ", F.col("callees"))]
    parts += [F.lit("```"), code_fence(lang), F.lit("\n"), F.col("code"), F.lit("\n```\n")]
    return F.concat(*parts)


def with_section(blocks: DataFrame, graph: DataFrame | None = None) -> DataFrame:
    """Scrubbed prompt text of each block as `section`. Blocks may bring their call context
    (`callers`, `callees`) along; else it is looked up in `graph`, if given."""
    if graph is not None:
        blocks = with_call_context(blocks, graph)
    return scrub(blocks).withColumn("section", section("callers" in blocks.columns))


def build_prompts(batches: DataFrame, graph: DataFrame | None = None) -> DataFrame:
    """(repo, batch_id, prompt). The token limit of a batch bounds the list behind a prompt."""
    sections = with_section(batches, graph).select("repo", "batch_id", "ord", "section")
    ordered = F.sort_array(F.collect_list(F.struct("ord", "section")))
    return sections.groupBy("repo", "batch_id").agg(
        F.array_join(F.transform(ordered, lambda s: s["section"]), "").alias("prompt"))
