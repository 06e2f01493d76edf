"""Equal texts, directory and chains against plain Python."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from reviewlake.llm import exact_dedup


def plain(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return Counter((i, keep[t or ""], len(groups[t or ""]),
                    hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


def check(rows, frame, **options):
    got = exact_dedup.equal_groups(frame, **options).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == plain(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({t or "" for _, t in rows})  # one row of each text
    assert len({r.text_sha256 for r in kept}) == len(kept)
    assert all(r.doc_id == r.keep_id for r in kept)


def texts(seed, n=400):
    rng = random.Random(seed)
    few = ["", "a", "b ", " b", "é", "A" * 5000]
    return [(i, rng.choice(few) if rng.random() < 0.5 else f"text {rng.randrange(200)}")
            for i in range(n)]


@pytest.mark.parametrize("capacity", [3, 10_000])
def test_groups(spark, capacity):
    rows = texts(1)
    check(rows, spark.createDataFrame(rows, "doc_id long, text string"), capacity=capacity)


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_hashes_that_collide_are_chained(spark, monkeypatch, bits):
    monkeypatch.setattr(exact_dedup, "text_hash", lambda text: F.xxhash64(text).bitwiseAND(
        (1 << bits) - 1))
    rows = texts(2)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check(rows, frame)


def test_directory_splits_overfull_buckets(spark):
    keys = spark.range(1000).select(F.xxhash64("id").alias("key"))
    near = spark.range(50).select((F.lit(5 << 56) + F.col("id") * (1 << 40)).alias("key"))
    slots, bits = exact_dedup.directory(keys.union(near), capacity=20)
    rows = slots.collect()
    every = [r.key & (1 << 64) - 1 for r in keys.union(near).collect()]
    load = Counter(k >> 64 - bits if bits else 0 for k in every)
    buckets = defaultdict(int)
    for r in rows:
        assert r.bucket >> bits - r.depth == r.slot >> bits - r.depth
        buckets[r.bucket, r.depth] += load[r.slot]
    assert sum(buckets.values()) == 1050 and max(buckets.values()) <= 20
    for (bucket, depth), n in buckets.items():  # no two buddies that would fit into one
        buddy = bucket ^ 1 << bits - depth
        if depth and (buddy, depth) in buckets:
            assert n + buckets[buddy, depth] > 20
    assert len({depth for _, depth in buckets}) > 1  # the crowded range is deeper


def test_odd_rows(odd_docs, no_docs):
    got = exact_dedup.equal_groups(odd_docs).collect()
    assert len(got) == odd_docs.count()
    groups = {r.doc_id: r for r in got}
    assert groups[1].keep_id == groups[2].keep_id == 2 and groups[1].group_size == 2
    assert groups[0].keep_id == groups[5].keep_id == 5 and groups[0].group_size == 3
    assert groups[None].keep_id is None and groups[None].kept
    assert exact_dedup.equal_groups(no_docs).count() == 0


def test_repeated_rows_and_null_ids(spark):
    rows = [(None, "x"), (None, "x"), (7, "y"), (7, "y"), (3, "y"), (None, "y")]
    check(rows, spark.createDataFrame(rows, "doc_id long, text string"))


def test_no_python_in_the_plan(docs):
    frame = exact_dedup.equal_groups(docs)
    plan = frame._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
