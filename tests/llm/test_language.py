from __future__ import annotations

import random

import numpy as np
import pytest

from reviewlake.llm import language
from reviewlake.llm.tables import held_out


def test_held_out_rows_are_known(docs):
    model = language.train(docs.where(~held_out("doc_id")))
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    rows = docs.where(held_out("doc_id")).collect()
    right = sum(got[r.doc_id].lang_pred == r.lang for r in rows)
    assert len(got) == docs.count() and right >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_more_families_than_two(spark):
    rng = random.Random(1)
    letters = {"en": "the and", "de": "sch ung", "fr": "eau que", "ru": "что это", "uk": "що їй",
               "xx": "zq qz"}
    rows = [(i, " ".join(rng.choices(letters[lang].split(), k=20)), lang)
            for i, lang in enumerate(list(letters) * 12)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert all(model.predict(text)[0] == lang for _, text, lang in rows)
    assert language.family("xx") == "xx" and language.family("en-US") == "germanic"


def test_odd_rows(odd_docs, no_docs):
    model = language.train(odd_docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(odd_docs, model).collect()}
    assert all(got[i] == ("und", 0.0) for i in (1, 2, 3, 4))
    assert got[6][0] == "de"
    kept = language.identified(odd_docs, model)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["0", "0", "5", "6", "None"]
    assert language.identify(no_docs, model).count() == 0


def test_nothing_to_learn_from(odd_docs, no_docs):
    model = language.train(no_docs)
    assert {r.lang_pred for r in language.identify(odd_docs, model).collect()} == {"und"}
    one = language.train(odd_docs.where("lang = 'en'"))
    assert one.predict("alpha") == ("en", 1.0)


def test_a_language_of_many_rows(spark, monkeypatch):
    """More labelled rows of one language than 2**23, above which hash times count is no long."""
    seen = []
    monkeypatch.setattr(language, "Model", lambda x, labels: seen.extend(labels))
    rows = spark.range(9_000_000).selectExpr(
        "id AS doc_id", "if(id < 100, 'fr', 'en') AS lang", "'the cat sat' AS text")
    language.train(rows)
    assert 150 <= seen.count("en") <= 350 and seen.count("fr") == 100


@pytest.mark.parametrize("seed", range(3))
def test_svm_separates(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(80, 5)).astype(np.float32)
    y = np.where(x @ np.array([1, -2, 0.5, 0, 0]) > 0, 1, -1)
    x += (y[:, None] * np.array([0.5, -1, 0.2, 0, 0])).astype(np.float32)
    w = language.train_svm(x, y)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() >= 0.97


@pytest.mark.parametrize("text,has", [
    ("\u00b2 \u00bd \u2167 \u2460 12 _", False), ("\u0301", False), ("x\u00b2", True),
    ("\u4e2d", True), ("\u02b0", True), ("\u00aa", True)])
def test_only_letters_make_a_language(text, has):
    assert (language.trigrams(text) is not None) == has


def test_votes_one_by_one(docs):
    """Both steps of a prediction, worked out pair by pair from the machines' weights."""
    model = language.train(docs)

    def winner(machines, x):
        votes, sums = dict.fromkeys(machines.classes, 0), dict.fromkeys(machines.classes, 0.0)
        for (i, j), w in zip(machines.pairs, machines.weights):
            margin = float(sum(a * b for a, b in zip(w[:-1].tolist(), x.tolist()) if b) + w[-1])
            a, b = machines.classes[i], machines.classes[j]
            votes[a if margin >= 0 else b] += 1
            sums[a] += margin
            sums[b] -= margin
        return max(machines.classes, key=lambda c: (votes[c], sums[c]))

    rows = docs.collect()[:60]
    for r in rows:
        x = language.features(r.text)
        if x is None:
            assert model.predict(r.text) == ("und", 0.0)
            continue
        family = winner(model.top, x)
        assert model.predict(r.text)[0] == winner(model.within[family], x)
    assert len({model.predict(r.text)[0] for r in rows}) > 2


@pytest.mark.parametrize("seed", range(3))
def test_svm_against_a_plain_solver(seed):
    """The loss that dual coordinate descent reaches is that of many plain subgradient steps."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(60, 4)).astype(np.float32)
    y = np.where(x @ np.array([1, -1, 0.5, 0]) + 0.5 * rng.normal(size=60) > 0.3, 1, -1)
    one = np.hstack([x, np.ones((60, 1), np.float32)])
    cost = np.where(y > 0, 60 / (2 * (y > 0).sum()), 60 / (2 * (y < 0).sum())) * 0.1

    def loss(w):
        return 0.5 * w @ w + (cost * np.maximum(0, 1 - y * (one @ w))).sum()

    w = best = np.zeros(5)
    for t in range(1, 40_001):
        short = y * (one @ w) < 1
        w = w - (w - (cost * y * short) @ one) / t ** 0.5 / 20
        best = min(best, w, key=loss)
    assert loss(language.train_svm(x, y, cost=0.01).astype(float)) <= 1.01 * loss(best) + 1e-6
