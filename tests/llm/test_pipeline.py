from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline
from test_decontaminate import words
from test_simhash import plain_fingerprint
from test_token_files import plain_index
from tokenizers import Tokenizer

from reviewlake.llm import decontaminate, mixing
from reviewlake.llm.queries import TOKENIZER


def test_stages(spark, sf_dir, docs):
    kept = docs
    for name, apply in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        kept = apply(spark, kept, sf_dir)
        assert kept.columns == docs.columns and kept.schema == docs.schema, name
        assert {r.doc_id for r in kept.select("doc_id").collect()} <= before
    result = corpus_pipeline.run(spark, sf_dir)
    assert result.count() == kept.count() > 0


def test_odd_rows(spark, sf_dir, odd_docs, no_docs):
    odd_docs = odd_docs.withColumnRenamed("fp", "n_chars")
    for start in (odd_docs, odd_docs.limit(0)):
        rows = start
        for _, apply in corpus_pipeline.STAGES:
            rows = apply(spark, rows, sf_dir)
        rows.count()


def leaks(text, items) -> bool:
    """Whether a text holds a window of an item, by counting equal words on every diagonal."""
    d = words(text)
    places = defaultdict(list)
    for p, w in enumerate(d):
        places[w].append(p)
    for item in items:
        n = min(len(item), decontaminate.WINDOW)
        if len(item) < decontaminate.SHORTEST:
            continue
        need = n - (decontaminate.tolerance(n) if n >= decontaminate.SPAN else 0)
        diagonals = defaultdict(list)
        for q, w in enumerate(item):
            for p in places[w]:
                diagonals[p - q].append(q)
        for shift, found in diagonals.items():
            for a in range(max(0, -shift), min(len(item), len(d) - shift) - n + 1):
                if sum(a <= q < a + n for q in found) >= need:
                    return True
    return False


def test_against_brute_force(spark, sf_dir, docs):
    """Every stage worked out plainly from what the one before it kept."""
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {i: r for i, r in rows.items() if any(c.isalpha() for c in r.text or "")}
    fps = {i: plain_fingerprint(r.text) for i, r in kept.items()}
    root = {i: i for i in kept}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(kept)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = {i: r for i, r in kept.items() if find(i) == i}
    items = [words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {i: r for i, r in kept.items() if not leaks(r.text, items)}
    assert len(rows) > len(kept) > len(clean) > 0
    frame = spark.createDataFrame(list(clean.values()), docs.schema)
    copies = {r.doc_id: r.copies for r in mixing.mix(frame).collect()}
    mixed = [(i, clean[i].text) for i, n in copies.items() for _ in range(n)]
    wanted = plain_index(mixed, Tokenizer.from_file(TOKENIZER))
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(map(tuple, got)) == Counter(wanted)
