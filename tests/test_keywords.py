"""Dictionaries as tables, against looking for every keyword in every text."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from reviewlake.functions import cwe
from reviewlake.operators import keywords


def plain(texts, words):
    ranked = sorted((prio, w) for prio, w in words if w)
    return sorted(((t, next((prio for prio, w in ranked if w in t.lower()), None)) for t in texts),
                  key=str)


def found(spark, texts, words):
    rows = spark.createDataFrame([(t,) for t in texts], "comment string").withColumn("id", F.lit(1))
    table = spark.createDataFrame([(p, w, p) for p, w in words], "prio int, keyword string, at int")
    return sorted(((r.comment, r["at"]) for r in keywords.with_dictionary(rows, table).collect()),
                  key=str)


@pytest.mark.parametrize("seed", range(3))
def test_every_pair(spark, seed):
    rng = random.Random(seed)
    letters = "abcdé中 \U0001f600"
    word = lambda n: "".join(rng.choices(letters, k=n))
    words = [(i, word(rng.choice([1, 2, 3, 4, 5, 7]))) for i in range(40)] + [(40, ""), (41, "z")]
    texts = [word(rng.randrange(12)).upper() for _ in range(300)] + ["", "Abc"] * 3
    assert found(spark, texts, words) == plain(texts, words)


def test_a_hundred_thousand_keywords(spark):
    """Each text holds a few keywords among words that nearly are; no pair of all is formed."""
    rng = random.Random(7)
    words = [f"{rng.getrandbits(40):010x}" for _ in range(100_000)]
    table = spark.createDataFrame([(i, w, i) for i, w in enumerate(words)],
                                  "prio int, keyword string, at int")
    texts, wanted = [], {}
    for n in range(2000):
        own = rng.sample(range(100_000), rng.randrange(4))
        text = " ".join([f"{n} the common words", *(words[i].upper() for i in own),
                         words[rng.randrange(100_000)][:-1] + "!"])
        texts.append((text,))
        wanted[text] = min(own, default=None)
    rows = keywords.with_dictionary(spark.createDataFrame(texts, "comment string"), table).collect()
    assert {r.comment: r["at"] for r in rows} == wanted and len(rows) == 2000


def test_equals_the_chain(spark):
    phrases = [f"Found {k.upper()} here" for k, _ in cwe.CWE_KEYWORDS] + [
        None, "", "nothing", "eval and xss", "pickled shells"]
    rows = spark.createDataFrame([(i % 9, p) for i, p in enumerate(phrases * 3)],
                                 "text int, comment string")
    chain = cwe.with_cwe(rows).withColumnRenamed("cwe_url", "url")
    table = keywords.with_dictionary(rows, cwe.cwe_keywords(spark))
    assert table.columns == chain.columns
    order = [str(r) for r in chain.collect()]
    assert sorted(str(r) for r in table.collect()) == sorted(order)


def test_no_rows_and_no_keywords(spark):
    rows = spark.createDataFrame([("xss",), (None,)], "comment string")
    none = cwe.cwe_keywords(spark).limit(0)
    assert [r.cwe_id for r in keywords.with_dictionary(rows, none).collect()] == [None, None]
    assert keywords.with_dictionary(rows.limit(0), cwe.cwe_keywords(spark)).count() == 0
    null = spark.createDataFrame([(1, None, "x"), (2, "", "y")], "prio int, keyword string, c string")
    assert [r.c for r in keywords.with_dictionary(rows, null).collect()] == [None, None]


def test_a_long_text(spark):
    text = "ab " * 100_000 + "needle"
    rows = spark.createDataFrame([(text,)], "comment string")
    table = spark.createDataFrame([(1, "needle", "n"), (0, "noodle", "o")],
                                  "prio int, keyword string, c string")
    assert keywords.with_dictionary(rows, table).first().c == "n"
