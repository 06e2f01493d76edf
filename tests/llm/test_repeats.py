"""Repeated passages against a version that looks at every string of every text."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from sessions import conf

from reviewlake.llm import repeats


def plain(texts: list[bytes], length: int):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts, length):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text binary").selectExpr(
        "doc_id", "cast(text as string) text")
    got = repeats.remove_repeats(frame).drop("kept").orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == plain([t or b"" for t in texts], length)


def passages(seed: int) -> list[bytes]:
    """Texts made of own words, shared passages, edited copies and periodic stretches."""
    rng = random.Random(seed)
    word = lambda: bytes(rng.choices(b"abcdefgh", k=rng.randrange(1, 9)))
    text = lambda n: b" ".join(word() for _ in range(n))
    shared = [text(rng.randrange(80, 300)) for _ in range(6)]
    out = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            kind = rng.randrange(5)
            if kind == 0:
                parts.append(rng.choice(shared))
            elif kind == 1:
                whole = bytearray(rng.choice(shared))
                for _ in range(rng.randrange(1, 4)):
                    whole[rng.randrange(len(whole))] = ord("z")
                parts.append(bytes(whole))
            elif kind == 2:
                piece = rng.choice(shared)
                a = rng.randrange(len(piece))
                parts.append(piece[a:a + rng.randrange(380, 430)])
            elif kind == 3:
                parts.append(text(3) * rng.randrange(1, 40))
            else:
                parts.append(text(rng.randrange(100)))
        out.append(b" ".join(parts))
    return out + [out[0], out[0], b"", None, b"a" * 1500, b"ab" * 300, b"a" * 399, b"a" * 400]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("bucket", [2, 1000])
@pytest.mark.parametrize("chunk", [1500, 1 << 21])
def test_passages(spark, monkeypatch, seed, bucket, chunk):
    monkeypatch.setattr(repeats, "BUCKET", bucket)
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    check(spark, passages(seed), repeats.LENGTH)


def test_documents(spark, docs):
    check(spark, [r.text.encode() for r in docs.orderBy("doc_id").collect()], repeats.LENGTH)


def test_odd_rows(odd_docs, no_docs):
    got = {r.doc_id: r for r in repeats.remove_repeats(odd_docs).collect()}
    assert got[1].n_bytes == 0 and got[1].kept == b""
    assert got[6].n_bytes == got[6].n_removed == 60_000 and got[6].n_spans == 1
    assert got[5].n_removed == 0
    assert repeats.remove_repeats(odd_docs).count() == odd_docs.count()
    assert repeats.remove_repeats(no_docs).count() == 0


def test_ranges_of_a_periodic_text_are_merged(spark, monkeypatch):
    monkeypatch.setattr(repeats, "STRETCH", 1000)
    rows = [(b"k", i, i) for i in range(5000)] + [(b"k", 9000, 9100), (b"k", 9050, 9050),
                                                  (b"m", 3, 3), (b"m", 404, 404), (b"n", 3, 403)]
    frame = spark.createDataFrame(rows, "key binary, first int, last int").repartition(3)
    got = {bytes(r.key): sorted(tuple(s) for s in r.spans) for r in repeats.merged(frame).collect()}
    assert got == {b"k": [(i, i + 999) for i in range(0, 5000, 1000)] + [(9000, 9100)],
                   b"m": [(3, 3), (404, 404)], b"n": [(3, 403)]}


def test_a_long_periodic_text(spark):
    check(spark, [b"ab" * 200_000, b"x" + b"ab" * 300 + b"y", b"q" * 500], repeats.LENGTH)


@pytest.mark.parametrize("often", [1, 2, 1000])
def test_frequent_contexts(spark, monkeypatch, often):
    monkeypatch.setattr(repeats, "OFTEN", often)
    unit = b"".join(b"%03d " % i for i in range(40))
    texts = passages(3)[:20] + [unit * n + b"end %d" % n for n in (4, 9, 30, 30)]
    check(spark, texts, repeats.LENGTH)


def test_rows_of_a_frequent_context_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(repeats, "OFTEN", 100)
    rows = [(7, 1, b"%d" % (i % 50), i, i) for i in range(4000)]
    rows += [(7, 2, b"a", 1, 2), (7, 3, b"b", 3, 4), (7, 3, b"c", 5, 6), (8, 1, b"d", 7, 8)]
    found = spark.createDataFrame(spark.sparkContext.parallelize(rows, 8),
                                  "gram long, context long, key binary, first int, last int")
    contexts = found.groupBy("gram", "context").agg(F.count("*").alias("n"))
    with conf(spark, spark__sql__autoBroadcastJoinThreshold=-1):
        got = repeats._met_again(found, contexts).withColumn(
            "task", F.spark_partition_id()).collect()
    assert Counter((bytes(r.key), r.first, r.last) for r in got) == Counter(
        (key, first, last) for gram, context, key, first, last in rows
        if (gram, context) in {(7, 1), (7, 3)})
    assert max(Counter(r.task for r in got).values()) < 1000
