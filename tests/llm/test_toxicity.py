from __future__ import annotations

import random

import pytest

from reviewlake.llm import toxicity
from reviewlake.llm.toxicity import Lexicon, Scorer, fold


@pytest.mark.parametrize("text,folded", [
    (None, "  "), ("", "  "), ("Idiot!", " idiot "), ("1d10t", " idiot "), ("ΙDΙΟΤ", " idiot "),
    ("ѕсum, l0ser", " scum ioser "), ("ｉｄｉｏｔ", " idiot "), ("id​iot id­iot", " idiot idiot "),
    ("$tup1d", " stupid "), ("réeux", " réeux "), ("a-b", " a b ")])
def test_fold(text, folded):
    assert fold(text) == folded


def plain_sum(text, weights, exceptions):
    """Heaviest entry at each word, without words inside an exception."""
    folded = fold(text)
    total = 0.0
    for at in range(len(folded)):
        inside = any(folded.startswith(p, a) for p in exceptions
                     for a in range(max(0, at - len(p) + 2), at + 1))
        here = [w for e, w in weights.items() if folded.startswith(e, at)]
        if here and not inside:
            total += max(here)
    return total


def test_matches_equal_a_plain_search():
    rng = random.Random(3)
    weights = {" bad ": 2.0, " ba": 1.0, " evii": 1.5, " nasty ": 3.0}
    exceptions = frozenset({" not bad ", " bazaar "})
    scorer = Scorer(Lexicon(weights, exceptions, (0, 0, 1)))
    for _ in range(300):
        text = " ".join(rng.choices(["bad", "not", "ba", "bazaar", "evil", "ev1lish", "nasty",
                                     "nastyish", "good"], k=rng.randrange(12)))
        import math

        density, total = scorer.features(text)
        assert total == pytest.approx(math.log1p(plain_sum(text, weights, exceptions)))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    clean = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(10)]
    rows = []
    for i in range(1200):
        words = rng.choices(clean, k=rng.randrange(5, 60))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vilething", "zorkish", "zorker"]))
        elif i % 7 == 0:
            words.insert(0, "zorkless")  # begins like a bad word
        rows.append((i, " ".join(words), int(toxic) if i % 11 else None))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_learning(labelled):
    lexicon = toxicity.learn(labelled, labelled)
    scorer = Scorer(lexicon)
    assert scorer.score("worda v1lething wordb") > 0.5 > scorer.score("worda wordb")
    assert scorer.score("zorkless worda wordb wordc") < 0.5
    assert scorer.score("wordaa zorker wordbb zorkish wordcc ѕz") > 0.5
    rows = toxicity.score(labelled, lexicon).join(labelled, "doc_id").collect()
    assert all((r.score >= 0.5) == (r.toxic == 1) for r in rows if r.toxic is not None)
    assert toxicity.learn(labelled.repartition(5), labelled) == lexicon


def test_nothing_to_learn_from(labelled, odd_docs, no_docs):
    for learned in (labelled.where("toxic = 0"), labelled.limit(0)):
        lexicon = toxicity.learn(labelled, learned)
        assert all(0 <= r.score <= 1 for r in toxicity.score(odd_docs, lexicon).collect())
    assert toxicity.score(no_docs, lexicon).count() == 0


def test_odd_rows(labelled, odd_docs):
    rows = toxicity.score(odd_docs, toxicity.learn(labelled, labelled)).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score < 0.5 for r in rows)
