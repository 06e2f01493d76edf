from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewlake.operators import batching as b
from sessions import conf


def packed(tokens: list[int], limit: int) -> list[int]:
    """The sequential rule, one block at a time."""
    ids, batch, held = [], -1, None
    for t in tokens:
        if t > limit:
            batch, held = batch + 1, None
        elif held is None or held + t > limit:
            batch, held = batch + 1, t
        else:
            held += t
        ids.append(batch)
    return ids


def cut(tokens: list[int], size: int) -> list[np.ndarray]:
    return [np.array(tokens[i:i + size]) for i in range(0, len(tokens), size)]


token_lists = st.lists(st.integers(0, 14), min_size=1, max_size=60)


@settings(max_examples=400, deadline=None)
@given(token_lists, st.integers(1, 12), st.integers(1, 9))
def test_chunks_are_numbered_like_the_whole(tokens, limit, size):
    state, started, ids = b.NO_BATCH, 0, []
    for chunk in cut(tokens, size):
        opened, left = b.enter(b.summarise(chunk, limit), state)
        numbers, state, now = b.number(chunk, limit, state, started)
        assert (state, now) == (left, started + opened)
        ids, started = ids + numbers.tolist(), now
    assert ids == packed(tokens, limit)


@settings(max_examples=400, deadline=None)
@given(token_lists, st.integers(1, 12), st.integers(1, 9))
def test_a_chain_acts_like_its_parts(tokens, limit, size):
    functions = [b.summarise(chunk, limit) for chunk in cut(tokens, size)]
    whole = functions[0]
    for f in functions[1:]:
        whole = b.chain(whole, f)
    for entry in range(b.NO_BATCH, limit + 1):
        state, opened = entry, 0
        for f in functions:
            n, state = b.enter(f, state)
            opened += n
        assert b.enter(whole, entry) == (opened, state)


def rows_of(spark, groups: dict[str, list[int]]):
    return spark.createDataFrame(
        [(repo, i, t) for repo, tokens in groups.items() for i, t in enumerate(tokens)],
        "repo string, ord long, tokens long")


@pytest.mark.parametrize("chunk_rows,stretch_chunks", [(5, 3), (7, 1000), (10_000, 10)])
def test_assign_over_many_chunks_and_a_hot_repo(spark, chunk_rows, stretch_chunks):
    rng = random.Random(7)
    sizes = {"hot": 900, "mid": 61, "one": 1, "five": 5}
    groups = {r: [rng.choice([0, 1, 7, 20, 45, 100, 101, 300]) for _ in range(n)]
              for r, n in sizes.items()}
    rows = rows_of(spark, groups).repartition(5)
    for records in (10_000, 13):  # rows that reach Python at a time
        with conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch=records):
            found = b.assign(rows, 100, chunk_rows, stretch_chunks)
            got = {r: [x.batch_id for x in sorted(rs, key=lambda x: x.ord)]
                   for r, rs in _by_repo(found)}
        assert got == {r: packed(t, 100) for r, t in groups.items()}


def test_chunks_stay_whole_behind_a_join_that_adapts(spark):
    tokens = [i * 7 % 61 for i in range(40_000)]
    rows = spark.range(0, 40_000, 1, 8).select(
        F.lit("r").alias("repo"), F.col("id").alias("ord"),
        (F.col("id") * 7 % 61).alias("tokens")).repartition(8)
    # few entries by what was measured, not by what was planned: the join turns into a broadcast
    with conf(spark, spark__sql__autoBroadcastJoinThreshold=64 << 10,
              spark__sql__adaptive__coalescePartitions__enabled="false"):
        got = [x.batch_id for x in sorted(b.assign(rows, 100, 1000).collect(), key=lambda x: x.ord)]
    assert got == packed(tokens, 100)


def _by_repo(df):
    rows = df.collect()
    return [(r, [x for x in rows if x.repo == r]) for r in {x.repo for x in rows}]


def test_an_exact_fit_stays_and_a_large_block_stands_alone(spark):
    found = b.assign(rows_of(spark, {"r": [60, 40, 1, 500, 2, 98, 1]}), 100)
    assert [x.batch_id for x in found.orderBy("ord").collect()] == [0, 0, 1, 2, 3, 3, 4]


def test_no_rows(spark):
    assert b.assign(rows_of(spark, {"r": []}), 100).count() == 0


def test_caps(spark):
    ids = b.assign(rows_of(spark, {"a": [60] * 5, "b": [60] * 5}), 100)
    assert b.cap_batches(ids, 2).count() == 4
    targets = spark.createDataFrame([("a", 1), ("b", 3)], "repo string, max_batches int")
    capped = b.cap_batches(ids, None, targets).groupBy("repo").agg(F.count("*").alias("n"))
    assert {r.repo: r.n for r in capped.collect()} == {"a": 1, "b": 3}


def test_exact_encoder(spark):
    from reviewlake.functions.tokens import with_tokens

    blocks = spark.createDataFrame([("f.py", 1, "g", "a b")],
                                   "file_path string, line_number int, name string, code string")
    exact = with_tokens(blocks, lambda: str.split).first()
    text = "\nFile: f.py | Line: 1 | Function: g\n```python\na b\n```\n"
    assert exact.tokens == len(text.split())
    assert with_tokens(blocks).first().tokens == -(-len(text) // 4)
