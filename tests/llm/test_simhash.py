"""Fingerprints and groups against plain versions that compare all pairs."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from reviewlake.llm import simhash
from reviewlake.llm.components import components


def plain_fingerprint(text: str | None) -> int:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [words[i:i + 3] for i in range(len(words) - 2)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << bit for bit in range(64)
               if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def plain_groups(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i)
             if (fps[i] ^ fps[j]).bit_count() <= 3]
    part = plain_components(range(len(rows)), links)
    least = defaultdict(lambda: None)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[part[i]] = min(doc_id, least[part[i]] if least[part[i]] is not None else doc_id)
    return sorted(((d, fps[i], least[part[i]]) for i, (d, _) in enumerate(rows)), key=str)


def spark_groups(docs):
    return sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id)
                   for r in simhash.near_groups(docs).collect()), key=str)


def test_groups_of_documents(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert spark_groups(docs) == plain_groups(rows)


def test_odd_rows(odd_docs, no_docs):
    assert spark_groups(odd_docs) == plain_groups([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert spark_groups(no_docs) == []


def test_fingerprint_of_a_long_text():
    text = " ".join(random.Random(1).choices("abcdefghij", k=70_000))
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("split_over", [4, 2048])
def test_links_have_all_components(spark, monkeypatch, split_over):
    monkeypatch.setattr(simhash, "SPLIT_OVER", split_over)
    rng = random.Random(split_over)
    fps = {0}
    while len(fps) < 400:
        base = rng.choice(sorted(fps)) if rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.randrange(5)):
            base ^= 1 << rng.randrange(64)
        fps.add(base)
    fps = sorted(fps)
    frame = spark.createDataFrame([(simhash._signed(f),) for f in fps * 2], "fp long")
    links = [tuple(x & (1 << 64) - 1 for x in r) for r in simhash.near_links(frame).collect()]
    wanted = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    assert plain_components(fps, links) == plain_components(fps, wanted)


def test_a_family_of_many_is_dealt_out(spark):
    """Fingerprints that share half their bits: no bucket holds them all, no link is lost."""
    rng = random.Random(8)
    half = rng.getrandbits(32) << 32
    fps = sorted({half | rng.getrandbits(32) for _ in range(20_000)})
    pairs = [(f, f ^ 1 << rng.randrange(32) ^ 1 << rng.randrange(32)) for f in fps[::100]]
    frame = spark.createDataFrame([(simhash._signed(f),) for f in {*fps, *sum(pairs, ())}], "fp long")
    buckets = simhash.filed(frame).groupBy("mask", "key").count()
    assert buckets.agg({"count": "max"}).first()[0] <= simhash.SPLIT_OVER
    got = simhash.near_links(frame).collect()
    roots = plain_components({x for p in pairs for x in p} | {
        x & (1 << 64) - 1 for r in got for x in r}, [
        tuple(x & (1 << 64) - 1 for x in r) for r in got])
    assert all(roots[a] == roots[b] for a, b in pairs)


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(3)
    n = 60
    links = {"path": [(i, i + 1) for i in range(n)], "star": [(7, i) for i in range(n)],
             "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(40)],
             "none": []}[shape] + [(None, 1)]
    got = components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    links = [(a, b) for a, b in links if a is not None and a != b]
    nodes = {x for link in links for x in link}
    assert {(r.node, r.root) for r in got} == set(plain_components(nodes, links).items())
    assert len(got) == len(nodes)


def test_keep_one(spark, odd_docs, no_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    # 1, 2 and 3 have no words, like each other; 0 and 5 are copies
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["0", "1", "4", "6", "None"]
    assert simhash.keep_one(no_docs).count() == 0


def test_keep_one_of_repeated_and_missing_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(200)) for x in "abc")
    rows = [(1, a, 0), (1, b, 1), (1, a, 2), (2, a, 3), (None, a, 4), (None, c, 5), (None, c, 6),
            (None, c + " end", 7), (3, b, 8)]
    for parts in (1, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string, _id int").repartition(parts)
        kept = simhash.keep_one(docs).collect()
        assert sorted(((r.doc_id, r.text[:2]) for r in kept), key=str) == [
            (1, "a0"), (1, "b0"), (None, "c0")]
