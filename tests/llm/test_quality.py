from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from reviewlake.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text: str | None):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    repeated = len(inside)
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            sum(line in lines[:i] for i, line in enumerate(lines)), repeated,
            n < 10 or 100 * repeated > 20 * n)


def spark_counts(docs):
    return sorted(((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines,
                               r.n_repeat_words, r.base_failed))
                   for r in quality.judge(docs).collect()), key=str)


def test_documents(docs):
    assert spark_counts(docs) == sorted(((r.doc_id, plain(r.text)) for r in docs.collect()),
                                        key=str)


def test_odd_texts(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choices(["a", "b ", "é", "\n", "#", "\x1c", "\xa0", "\t", "c d e f g "],
                                 k=rng.randrange(80))) for _ in range(300)] + [None, "", "\n\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr(
        "*", "1 AS n_words", "true AS kept")
    assert spark_counts(docs) == sorted(((i, plain(t)) for i, t in enumerate(texts)), key=str)


def test_odd_rows(odd_docs, no_docs):
    rows = quality.judge(odd_docs).collect()
    assert len(rows) == odd_docs.count() and not any(r.kept for r in rows)
    assert quality.judge(no_docs).count() == 0


def test_verdicts_agree_with_labels(spark):
    """Labels are not used to judge; they show that bad texts go and good ones stay."""
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("quality IS NOT NULL").selectExpr(
        "doc_id", "quality AS label")
    rows = quality.judge(spark.read.parquet(f"{folder}/documents.parquet")).join(
        labels, "doc_id").where("not base_failed").collect()
    good = [r.kept for r in rows if r.label == 1]
    bad = [r.kept for r in rows if r.label == 0]
    assert len(good) > 500 and len(bad) > 20
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.1


def test_posterior_by_bayes(docs):
    """quality, worked out from the model of the same votes kind by kind."""
    rows = quality.judge(docs)
    votes = quality.measure(docs).select("doc_id", *[
        rule().cast("int").alias(name) for name, rule in quality.RULES.items()]).collect()
    names = list(quality.RULES)
    table = Counter(tuple(r[n] for n in names) for r in votes)
    patterns = sorted(table)
    model = quality.estimate(np.array(patterns, float), np.array([table[p] for p in patterns], float))
    posterior = {}
    for p in patterns:
        weights = []
        for share, rates in zip(model.shares, model.bad_votes):
            w = share
            for vote, rate in zip(p, rates):
                w *= rate if vote < 0 else 1 - rate if vote > 0 else 1
            weights.append(w)
        posterior[p] = weights[0] / sum(weights)
    wanted = {r.doc_id: posterior[tuple(r[n] for n in names)] for r in votes}
    got = {r.doc_id: r for r in rows.collect()}
    assert len(set(posterior.values())) > 3
    for doc_id, q in wanted.items():
        assert got[doc_id].quality == pytest.approx(q, abs=1e-9)
        assert got[doc_id].kept == (not got[doc_id].base_failed and q >= quality.KEEP_AT)


@pytest.mark.parametrize("seed", range(4))
def test_windows_of_long_texts(seed):
    rng = random.Random(seed)
    words = [rng.choice([b"a", b"b", b"c", b"dd"]) for _ in range(rng.choice([0, 4, 5, 60, 300]))]
    assert quality._repeated_in_long(words, 5) == quality.repeated_words(words) if words else True
    words = [str(rng.randrange(60)).encode() for _ in range(500)]
    assert quality._repeated_in_long(words, 5) == quality.repeated_words(words)


@pytest.mark.parametrize("seed", range(3))
def test_estimate_finds_kinds(seed):
    """Votes drawn from a good kind and two bad ones; the model tells them apart."""
    rng = np.random.default_rng(seed)
    kind = rng.choice(3, size=4000, p=[0.8, 0.12, 0.08])
    bad = np.array([[0.03, 0.02, 0.05], [0.95, 0.1, 0.05], [0.03, 0.1, 0.97]])[kind]
    votes = np.where(rng.random(bad.shape) < bad, -1, 1)
    votes[rng.random(bad.shape) < 0.1] = 0
    patterns, counted = np.unique(votes, axis=0, return_counts=True)
    model = quality.estimate(patterns.astype(float), counted.astype(float))
    good = quality._shares(model.log_odds(votes.astype(float)))[:, 0] >= 0.5
    assert (good == (kind == 0)).mean() > 0.9
    assert model.shares.sum() == pytest.approx(1)
