"""Files of many repositories to findings and health."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import with_tokens
from ..operators import batching, extract, findings, health, prompts
from ..operators.call_graph import latest_calls, with_call_context
from ..operators.review import (
    Reviewer, batch_errors, hit_findings, parse_reports, review_batches, rule_hits)
from ..session import materialize

_PLACE = ["repo", "file_path", "file_ord"]


class Scan(NamedTuple):
    parse_errors: DataFrame
    batches: DataFrame  # repo, file_path, file_ord, name, ord, tokens, batch_id; no code
    findings: DataFrame  # with repo, batch_id, pos
    batch_errors: DataFrame | None  # only with a reviewer of one's own
    health: DataFrame  # every repo of the files


def scan(files: DataFrame, max_tokens: int = batching.MAX_TOKENS, max_batches: int | None = None,
         languages: Sequence[str] | None = None, reviewer: Reviewer | None = None,
         max_code: int = extract.MAX_CODE_LENGTH, feedback: DataFrame | None = None,
         targets: DataFrame | None = None) -> Scan:
    """Parse once, pack, review, score every repo of `files`.

    All batches are reviewed unless a caller asks for the first `max_batches` per repo, or as many
    as `targets(repo, max_batches)` says. Files are parsed once. The built-in rules read whole code
    in that pass, and what is written of a definition is its place, its tokens and its hits; only a
    reviewer of one's own has code written, moved to its place and then into its prompt, of which
    a block takes at most `max_code` characters. Tokens are those of prompts. Packing and call
    context work on rows without code. `feedback(repo, finding_key, verdict)` holds latest
    verdicts.
    """
    definitions = extract.extract_definitions(files)
    if reviewer is None:
        parsed = materialize(_without_code(definitions, max_code), "definitions")
        blocks = parsed.where("_block")
        definitions, tokens = parsed.where("_first"), blocks.where("_first")
    else:
        definitions = materialize(definitions, "definitions")
        blocks = extract.to_blocks(definitions)
        shown = extract.truncate_code(blocks, max_code)
        tokens = with_tokens(shown)
    if languages is not None:
        wanted = F.col("language").isin(*languages)
        blocks, tokens = blocks.filter(wanted), tokens.filter(wanted)
    packed = pack(tokens, max_tokens)
    used = packed
    if max_batches is not None or targets is not None:
        used = batching.cap_batches(packed, max_batches, targets)
    errors = None
    if reviewer is None:
        found = hit_findings(blocks).withColumnRenamed("block_ord", "file_ord").join(
            used.select(*_PLACE, "ord", "batch_id"), _PLACE)
        place = F.struct("ord", "line_number", "rule")
        found = found.withColumn("pos", place).drop("file_ord", "ord", "rule")
    else:
        graph = latest_calls(extract.to_calls(definitions))
        code = shown if languages is None else shown.filter(wanted)
        code = code.withColumnRenamed("ord", "file_ord")
        placed = code.join(with_call_context(used, graph).drop("name", "language"), _PLACE)
        reports = materialize(review_batches(prompts.build_prompts(placed), reviewer), "reports")
        found, errors = parse_reports(reports)[0], batch_errors(reports)
    if reviewer is None:
        found = materialize(found, "findings")  # counted and scored below
    counts = found.groupBy("repo").agg(F.count("*").alias("_findings"))
    scored = health.health(found, feedback, repos=files).join(counts, "repo", "left").select(
        "repo", F.coalesce("_findings", F.lit(0)).alias("findings"), "score", "grade", "color")
    return Scan(extract.parse_errors(definitions), packed, found, errors, scored)


def _without_code(definitions: DataFrame, max_code: int) -> DataFrame:
    """Definitions and files that could not be parsed, with tokens and rule hits instead of code.

    `_block` marks what goes to review, `_first` one row of each definition.
    """
    rows = definitions.withColumn("file_path", F.col("path"))
    counted = with_tokens(extract.truncate_code(rows.withColumn("_whole", F.col("code")), max_code))
    counted = counted.withColumns({"code": F.col("_whole"), "_block": extract.is_block()})
    carried = ["repo", "path", "file_path", "language", "reviewable", "error", "name",
               "line_number", "ord", "tokens", "_block"]
    reviewed = counted.withColumn("code", F.when(F.col("_block"), F.col("code")))
    return rule_hits(reviewed, carried, outer=True)


def pack(tokens: DataFrame, max_tokens: int = batching.MAX_TOKENS) -> DataFrame:
    """Order and batch of each block, from rows with their tokens."""
    slim = tokens.select("repo", "language", "file_path", "name", "ord", "tokens")
    ordered = extract.order_blocks(slim.withColumn("file_ord", F.col("ord")))
    return batching.assign(ordered, max_tokens)


def indexed(found: DataFrame) -> DataFrame:
    """Findings with their position `idx` in the repo."""
    return findings.with_finding_index(found)
