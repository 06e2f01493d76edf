"""Greedy packing of ordered blocks into batches of a bounded token count.

The rule is sequential: a block joins the open batch if it still fits, else it opens the next
one; a block above the limit stands alone. Where a batch starts depends on all starts before
it, so a window sum cannot express it. One repository may hold a third of all rows, so it must
not be one task either.

The only thing that crosses a cut between two rows is the token count of the open batch. So a
chunk of consecutive rows acts as a step function from the count it is entered with to the
count it is left with, with few steps: after the first start inside the chunk, the entry no
longer matters. Chunks are summarised in parallel, the summaries of each long stretch are
chained into one, the few stretches of a repository are walked once, and then every chunk is
numbered in parallel, knowing how it is entered.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

MAX_TOKENS = 3000  # fixed value: default limit of a batch
CHUNK_ROWS = 1 << 16  # rows of a repository in one chunk, by `ord`
STRETCH_CHUNKS = 1 << 12  # chunks in one stretch
NO_BATCH = -1  # entry state: no batch is open

_STEPS = "lo long, hi long, starts long, leave long, adds boolean"


class Step(NamedTuple):
    """Entered with lo..hi, a chunk opens `starts` batches and is left with `leave` tokens in
    the open one (`adds`: with `leave` more than it was entered with)."""

    lo: int
    hi: int
    starts: int
    leave: int
    adds: bool


def _next_starts(tokens: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a batch starting at each row: the row where the next one starts; also sums."""
    upto = np.cumsum(tokens)
    before = upto - tokens
    following = np.searchsorted(upto, before + limit, side="right")
    alone = tokens > limit
    following[alone] = np.flatnonzero(alone) + 1
    return following, upto, before


def summarise(tokens: np.ndarray, limit: int) -> list[Step]:
    n = len(tokens)
    following, upto, before = _next_starts(tokens, limit)
    nexts, alone = following.tolist(), (tokens > limit).tolist()
    starts, leave = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        j = nexts[i]
        if j < n:
            starts[i], leave[i] = starts[j] + 1, leave[j]
        else:
            starts[i] = 1
            leave[i] = NO_BATCH if alone[i] else int(upto[-1] - before[i])
    steps = [Step(NO_BATCH, NO_BATCH, starts[0], leave[0], False)]
    for i in range(n):  # entered with lo..hi, the first start is at row i
        lo, hi = max(0, limit - int(upto[i]) + 1), limit - int(before[i])
        if lo <= hi:
            steps.append(Step(lo, hi, starts[i], leave[i], False))
        if lo == 0:
            break
    if upto[-1] <= limit:
        steps.append(Step(0, limit - int(upto[-1]), 0, int(upto[-1]), True))
    return steps


def enter(steps: list[Step], state: int) -> tuple[int, int]:
    step = next(s for s in steps if s.lo <= state <= s.hi)
    return step.starts, step.leave + (state if step.adds else 0)


def chain(first: list[Step], second: list[Step]) -> list[Step]:
    """The step function of two neighbours taken as one chunk."""
    out: list[Step] = []
    for a in first:
        if not a.adds:
            starts, leave = enter(second, a.leave)
            out.append(Step(a.lo, a.hi, a.starts + starts, leave, False))
            continue
        for b in second:
            lo, hi = max(a.lo + a.leave, b.lo), min(a.hi + a.leave, b.hi)
            if lo <= hi:
                leave = b.leave + (a.leave if b.adds else 0)
                out.append(Step(lo - a.leave, hi - a.leave, a.starts + b.starts, leave, b.adds))
    return out


def number(tokens: np.ndarray, limit: int, state: int,
           started: int) -> tuple[np.ndarray, int, int]:
    """Batch ids of rows entered with `state` after `started` batches were opened, and the same
    two values behind them."""
    n = len(tokens)
    following, upto, before = _next_starts(tokens, limit)
    at = 0 if state == NO_BATCH else int(np.searchsorted(upto, limit - state, side="right"))
    opens, last = np.zeros(n, dtype=np.int64), None
    while at < n:
        opens[at], last = 1, at
        at = int(following[at])
    ids = started + np.cumsum(opens) - 1
    if last is None:
        state += int(upto[-1])
    else:
        state = NO_BATCH if tokens[last] > limit else int(upto[-1] - before[last])
    return ids, state, int(ids[-1]) + 1


def _runs(frame: pd.DataFrame) -> Iterator[tuple[tuple[str, int], slice]]:
    """Stretches of equal (repo, chunk) in sorted rows."""
    repos, chunks = frame["repo"].to_numpy(), frame["chunk"].to_numpy()
    changes = np.flatnonzero((repos[1:] != repos[:-1]) | (chunks[1:] != chunks[:-1])) + 1
    bounds = [0, *changes.tolist(), len(frame)]
    for begin, end in zip(bounds, bounds[1:]):
        if begin < end:
            yield (repos[begin], int(chunks[begin])), slice(begin, end)


def _by_chunk(rows: DataFrame) -> DataFrame:
    """Whole chunks per partition, in order: one pass in Python serves any number of them."""
    return rows.repartition("repo", "chunk").sortWithinPartitions("repo", "chunk", "ord")


def _functions(frame: pd.DataFrame) -> list[tuple[int, list[Step]]]:
    """Chunk functions of a frame of steps, in chunk order."""
    rows = frame.sort_values(["chunk", "lo"])
    return [
        (int(chunk), [Step(int(s.lo), int(s.hi), int(s.starts), int(s.leave), bool(s.adds))
                      for s in steps.itertuples(index=False)])
        for chunk, steps in rows.groupby("chunk", sort=True)
    ]


def _walk(functions: list[tuple[int, list[Step]]], state: int, started: int):
    for chunk, steps in functions:
        yield chunk, state, started
        opened, state = enter(steps, state)
        started += opened


def assign(rows: DataFrame, max_tokens: int = MAX_TOKENS, chunk_rows: int = CHUNK_ROWS,
           stretch_chunks: int = STRETCH_CHUNKS) -> DataFrame:
    """Add `batch_id` (0-based, per repo) to rows that have repo, ord and tokens.

    `ord` is unique within a repo and roughly dense; its gaps only make chunks smaller. Rows
    pass through Python, so they should not carry code; see `assign_batches`. They are written
    twice: for the summaries, and with the state their chunk is entered with for the numbering.
    """
    longs = {name: F.col(name).cast("long") for name in ("ord", "tokens")}
    rows = rows.withColumns(longs).withColumn("chunk", F.expr(f"ord div {chunk_rows}"))
    numbered = T.StructType(
        [*rows.drop("chunk").schema.fields, T.StructField("batch_id", T.LongType())])
    rows = materialize(rows, "tokens")

    def number_chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, started = None, NO_BATCH, 0
        for frame in frames:
            tokens, ids = frame["tokens"].to_numpy(), np.zeros(len(frame), dtype=np.int64)
            states, starts = frame["state"].to_numpy(), frame["started"].to_numpy()
            for chunk, run in _runs(frame):
                if chunk != current:
                    current, state, started = chunk, int(states[run.start]), int(starts[run.start])
                ids[run], state, started = number(tokens[run], max_tokens, state, started)
            yield frame.drop(columns=["chunk", "state", "started"]).assign(batch_id=ids)

    entries = _chunk_entries(rows, max_tokens, stretch_chunks)
    fresh = {"state": F.lit(NO_BATCH).cast("long"), "started": F.lit(0).cast("long")}
    entered = rows.join(entries, ["repo", "chunk"], "left").withColumns(
        {name: F.coalesce(name, default) for name, default in fresh.items()})
    # written: dealt out straight behind the join, its shuffle would serve for both, and adaptive
    # execution may split that one in the middle of a chunk
    entered = materialize(entered.select(*rows.columns, *fresh), "entered")
    return _by_chunk(entered).mapInPandas(number_chunks, numbered)


def _chunk_entries(rows: DataFrame, max_tokens: int, stretch_chunks: int) -> DataFrame:
    """(repo, chunk, state, started) for repos longer than a chunk."""
    spans = rows.groupBy("repo").agg(
        F.min("chunk").alias("first"), F.max("chunk").alias("last")
    ).filter(F.col("first") < F.col("last"))
    spans = materialize(spans, "spans")  # written: its join must be splittable, see call_graph

    def summarise_chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, parts = None, []

        def finished() -> list[tuple]:
            steps = summarise(np.concatenate(parts), max_tokens) if parts else []
            return [(*current, *step) for step in steps]

        for frame in frames:
            out, tokens = [], frame["tokens"].to_numpy()
            for chunk, run in _runs(frame):
                if chunk != current:
                    out += finished()
                    current, parts = chunk, []
                parts.append(tokens[run])
            yield pd.DataFrame(out, columns=["repo", "chunk", *Step._fields])
        yield pd.DataFrame(finished(), columns=["repo", "chunk", *Step._fields])

    def chain_stretch(key: tuple[Any, ...], frame: pd.DataFrame) -> pd.DataFrame:
        functions = [f for _, f in _functions(frame)]
        whole = functions[0]
        for f in functions[1:]:
            whole = chain(whole, f)
        return pd.DataFrame([(*key, *step) for step in whole],
                            columns=["repo", "chunk", *Step._fields])

    def walk_repo(key: tuple[Any, ...], frame: pd.DataFrame) -> pd.DataFrame:
        return _entry_frame(key[0], "stretch", list(_walk(_functions(frame), NO_BATCH, 0)))

    def walk_stretch(key: tuple[Any, ...], frame: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        state, started = int(entry["state"].iloc[0]), int(entry["started"].iloc[0])
        return _entry_frame(key[0], "chunk", list(_walk(_functions(frame), state, started)))

    steps, entry = f"repo string, chunk long, {_STEPS}", "state long, started long"
    long_rows = rows.join(spans.select("repo"), "repo", "left_semi").select(
        "repo", "chunk", "ord", "tokens")
    chunks = _by_chunk(long_rows).mapInPandas(summarise_chunks, steps)
    chunks = materialize(chunks, "chunks")
    stretch = F.expr(f"chunk div {stretch_chunks}").alias("stretch")
    stretches = chunks.groupBy("repo", stretch).applyInPandas(chain_stretch, steps)
    stretch_entries = stretches.groupBy("repo").applyInPandas(
        walk_repo, f"repo string, stretch long, {entry}")
    return (
        chunks.groupBy("repo", stretch)
        .cogroup(stretch_entries.groupBy("repo", "stretch"))
        .applyInPandas(walk_stretch, f"repo string, chunk long, {entry}")
    )


def _entry_frame(repo: str, name: str, entries: list[tuple[int, int, int]]) -> pd.DataFrame:
    frame = pd.DataFrame(entries, columns=[name, "state", "started"])
    frame.insert(0, "repo", repo)
    return frame


def assign_batches(blocks: DataFrame, max_tokens: int = MAX_TOKENS, **chunking) -> DataFrame:
    """`assign` for blocks with code: only (repo, ord, tokens) goes through the packing."""
    ids = assign(blocks.select("repo", "ord", "tokens"), max_tokens, **chunking)
    return blocks.join(ids.drop("tokens"), ["repo", "ord"])


def cap_batches(batches: DataFrame, n: int | None, targets: DataFrame | None = None) -> DataFrame:
    """First `n` batches of each repo, or as many as `targets(repo, max_batches)` allows.

    A repo that `targets` does not name falls back on `n`; None is no cap. Of several rows for a
    repo the largest number counts.
    """
    caps = F.lit(n).cast("long")
    if targets is not None:
        allowed = targets.groupBy("repo").agg(F.max("max_batches").alias("_allowed"))
        batches = batches.join(allowed, "repo", "left")
        caps = F.coalesce("_allowed", caps)
    return batches.filter(caps.isNull() | (F.col("batch_id") < caps)).drop("_allowed")


def batch_stats(batches: DataFrame) -> DataFrame:
    return batches.groupBy("repo", "batch_id").agg(
        F.count("*").alias("blocks"), F.sum("tokens").alias("tokens"))


def batch_totals(batches: DataFrame) -> DataFrame:
    """Blocks and batches per repo."""
    return batches.groupBy("repo").agg(
        F.count("*").alias("blocks"), (F.max("batch_id") + 1).alias("batches"),
        F.sum("tokens").alias("tokens"))

