"""First keyword of a dictionary table contained in a text, for dictionaries of any size.

Containment is no key to join on, but grams are: a text that contains a keyword contains each of its
grams. Every keyword is filed under one gram, the one that fewest texts have, and meets the
texts that have it; only these pairs are compared in full. Texts are taken once each, however many
rows share them, and travel as numbers until a pair is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

GRAM = 4  # characters; a shorter keyword is its own gram


def _gram_rows(rows: DataFrame, text: str, sizes: list[int], *keys: str) -> DataFrame:
    """(keys, gram) for every different gram of the given sizes."""
    chars = F.filter(F.split(F.col(text), ""), lambda c: c != "")
    # behind a generator the characters are a column, split once
    cut = rows.select(*keys, F.explode(F.array(chars)).alias("_chars"))

    def grams(size: int) -> Column:
        last = F.size("_chars") - size
        places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(
            F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat(*[F.get("_chars", i + k)
                                                        for k in range(size)]))

    found = F.concat(*[grams(s) for s in sizes]) if len(sizes) > 1 else grams(sizes[0])
    return cut.select(*keys, F.explode(F.array_distinct(found)).alias("gram"))


def _filed(words: DataFrame, texts: DataFrame, sizes: list[int]) -> DataFrame:
    """(prio, keyword, gram): every keyword that may occur, under its rarest gram.

    A keyword with a gram that no text has occurs nowhere and is left out.
    """
    own = materialize(
        _gram_rows(words.withColumn("_size", F.least(F.length("keyword"), F.lit(GRAM))), "keyword",
                   sizes, "prio", "keyword", "_size")
        .where(F.length("gram") == F.col("_size")).drop("_size"), "keyword-grams")
    wanted = materialize(own.select("gram").distinct(), "grams")
    texts_with = (_gram_rows(texts, "text", sizes, "id").join(wanted, "gram", "left_semi")
                  .groupBy("gram").agg(F.count("*").alias("n")))
    counted = own.join(texts_with, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = counted.groupBy("prio", "keyword").agg(
        F.min(F.struct("n", "gram")).alias("r"))
    return materialize(rarest.where("r.n > 0").select("prio", "keyword", "r.gram"), "filed")


def first_keyword(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(id, prio) of texts (id, text): the least `prio` of the keywords that a text contains.

    `dictionary` has (prio, keyword). Null and empty keywords are in no text; texts without a keyword
    give no row. Case counts; ids are unique.
    """
    words = materialize(dictionary.select("prio", "keyword").where(
        F.length("keyword") > 0).distinct(), "keywords")
    sizes = sorted(r[0] for r in words.select(
        F.least(F.length("keyword"), F.lit(GRAM))).distinct().collect())  # at most GRAM numbers
    if not sizes:
        return words.select(F.lit(0).cast("long").alias("id"), "prio").limit(0)
    filed = _filed(words, texts, sizes)
    pairs = _gram_rows(texts, "text", sizes, "id").join(filed, "gram").select(
        "id", "prio", "keyword")
    return (pairs.join(texts.select("id", "text"), "id")
            .where(F.col("text").contains(F.col("keyword")))
            .groupBy("id").agg(F.min("prio").alias("prio")))


def with_dictionary(rows: DataFrame, dictionary: DataFrame, col: str = "comment") -> DataFrame:
    """`rows` with the other columns of the first entry of `dictionary` (prio, keyword, ...) whose
    keyword their lower-cased `col` contains; null where there is none.

    `prio` tells entries apart and orders them.
    """
    entries = dictionary.drop("keyword")
    texts = materialize(
        rows.select(F.lower(F.col(col)).alias("text")).where("text IS NOT NULL").distinct()
        .withColumn("id", F.monotonically_increasing_id()), "texts")
    first = first_keyword(texts, dictionary).join(entries, "prio")
    found = materialize(texts.join(first, "id").select(
        F.col("text").alias("_key"), F.struct(*[c for c in entries.columns if c != "prio"])
        .alias("_entry")), "classified")
    keyed = rows.select(F.lower(F.col(col)).alias("_key"), F.struct("*").alias("_row"))
    return keyed.join(found, "_key", "left").select("_row.*", "_entry.*")
