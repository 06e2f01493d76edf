"""Mixing sources to target weights by entropy balancing.

Every source has a target of tokens. Among all document rates that meet the targets, those that
stray least from one copy of every document, in relative entropy over [0, MAX_COPIES], are
exponential tilts: rate = c / (1 + (c - 1) exp(-lambda x)), with c = MAX_COPIES, x the document's
size in mean sizes of its source and one multiplier per source. The multipliers solve the convex
dual. Newton's method finds them: each step is one grouped sum over the table of (source, size,
number of documents), which is as far as documents matter, with a bracket around every root.

Rates become whole copies so that each source's sum follows its target: sizes are rounded from the
largest to the smallest and each hands its error on, so what is left is about half the smallest
document. Documents of the same size differ by one copy at most, the extra ones going to the first
in hash order. Positions in that order come from range partitions, so a source or a group of
copies of any size is spread over tasks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.positions import running_offset
from .tables import stage

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
WORD = r"[^\x20\x09-\x0D]+"
STEPS = 60
TOLERANCE = 1e-9


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source") -> DataFrame:
    """(doc_id, source, size) per row, the size being its number of words; null texts have none."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
        .alias("size"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS,
            max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_no, source_size, docs, target) per source.

    Sources in order (null last) have the weights in turn and share the sum of all sizes. A share
    above `max_copies` times the source stops there and the excess is shared again by weight:
    with sources ordered by the share at which they stop, those before the level are full. The
    windows hold one row per source.
    """
    everything = W.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    by_stop = everything.orderBy(F.col("_stop") / F.col("_weight"), "source_no")
    earlier = by_stop.rowsBetween(W.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("source_no") % len(weights) + 1).cast("int"))
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    level = ((F.sum("source_size").over(everything) - before("_stop"))
             / (F.sum("_weight").over(everything) - before("_weight")))
    return (sized.groupBy("source").agg(F.sum("size").alias("source_size"),
                                        F.count("*").alias("docs"))
            .withColumn("source_no", F.row_number().over(by_name) - 1)
            .withColumn("_weight", weight)
            .withColumn("_stop", F.col("source_size") * max_copies)
            .withColumn("_level", level)
            .withColumn("_full", F.col("_level") * F.col("_weight") > F.col("_stop"))
            .withColumn("_level", F.max(F.when(~F.col("_full"), F.col("_level"))).over(everything))
            .select("source", "source_no", "source_size", "docs",
                    F.when(F.col("_full"), F.col("_stop").cast("double"))
                    .otherwise(F.least(F.col("_level") * F.col("_weight"),
                                       F.col("_stop").cast("double"))).alias("target")))


def _rate(multiplier: str, x: str, c: int):
    return c / (1 + (c - 1) * F.exp(-F.col(multiplier) * F.col(x)))


def balance(histogram: DataFrame, goals: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source_no, size, n, rate): the rates of documents by source and size.

    `histogram` has (source_no, size, n). A source whose target is all it can give has the rate
    `max_copies`; a source without words has the rate 1.
    """
    c = max_copies
    work = stage(
        histogram.join(goals.select("source_no", "source_size", "docs", "target"), "source_no")
        .withColumn("x", F.when(F.col("source_size") > 0, F.col("size") * F.col("docs")
                                / F.col("source_size")).otherwise(0.0))
        .withColumn("_fixed", F.when(F.col("source_size") == 0, 1.0)
                    .when(F.col("target") >= c * F.col("source_size"), float(c))),
        "histogram")
    open_ = work.where(F.col("_fixed").isNull())
    state = stage(open_.select("source_no", "target").distinct().select(
        "source_no", "target", F.lit(0.0).alias("m"), F.lit(None).cast("double").alias("low"),
        F.lit(None).cast("double").alias("high")), "multipliers")
    for _ in range(STEPS):
        rate = _rate("m", "x", c)
        sums = open_.join(state.drop("target"), "source_no").groupBy("source_no").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("g"),
            F.sum(F.col("n") * F.col("size") * F.col("x") * rate * (1 - rate / c)).alias("h"))
        state = stage(_newton(state.join(sums, "source_no")), "multipliers")
        worst = state.agg(F.max("error")).first()[0]
        state = state.drop("error")
        if worst is None or worst < TOLERANCE:
            break
    rate = F.coalesce("_fixed", _rate("m", "x", c))
    return (work.join(state.select("source_no", "m"), "source_no", "left")
            .select("source_no", "size", "n", rate.alias("rate")))


def _newton(at: DataFrame) -> DataFrame:
    """One step for every source; one that leaves its bracket is replaced by a halving."""
    over = F.col("g") > F.col("target")
    low = F.when(over, F.col("low")).otherwise(F.col("m"))
    high = F.when(over, F.col("m")).otherwise(F.col("high"))
    step = F.when(F.col("h") > 0, F.col("m") - (F.col("g") - F.col("target")) / F.col("h"))
    inside = (step > F.coalesce("_low", F.col("m") - 8)) & (step < F.coalesce(
        "_high", F.col("m") + 8))
    half = (F.coalesce("_low", F.col("m") - 8) + F.coalesce("_high", F.col("m") + 8)) / 2
    error = F.abs(F.col("g") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0))
    return at.withColumns({"_low": low, "_high": high}).select(
        "source_no", "target",
        F.when(error < TOLERANCE, F.col("m")).when(inside, step).otherwise(half).alias("m"),
        F.col("_low").alias("low"), F.col("_high").alias("high"), error.alias("error"))


def whole_copies(rates: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source_no, size, n, copies): copies of all n documents together.

    A group has one row per distinct size of a source, however many documents have it.
    """
    def round_down_sizes(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ascending=False)
        out, carry = [], 0.0
        for size, n, rate in zip(rows["size"], rows["n"], rows["rate"]):
            wanted = n * size * rate + carry
            copies = round(wanted / size) if size else n
            copies = min(max(copies, 0), max_copies * n)
            carry = wanted - copies * size
            out.append(copies)
        return pd.DataFrame({"source_no": rows["source_no"], "size": rows["size"],
                             "n": rows["n"], "copies": out})

    return rates.groupBy("source_no").applyInPandas(
        round_down_sizes, "source_no int, size long, n long, copies long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
        max_copies: int = MAX_COPIES) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) per row of `docs`.

    copies is at most `max_copies`; taken is copies times size. Rows that repeat an id are
    documents of their own; null ids, texts and sources are allowed, null being a source. An
    empty table gives no rows. Reruns agree.
    """
    sized = stage(sizes(docs, id_col, text_col, source_col), "sizes")
    goals = stage(targets(sized, weights, max_copies), "targets")
    named = sized.join(goals.select("source", "source_no"),
                       sized.source.eqNullSafe(goals.source)).select("doc_id", "source_no", "size")
    histogram = stage(named.groupBy("source_no", "size").agg(F.count("*").alias("n")), "histogram")
    rates = stage(balance(histogram, goals, max_copies), "rates")
    plan = (whole_copies(rates, max_copies).join(rates.drop("n"), ["source_no", "size"])
            .join(goals, "source_no"))
    placed = running_offset(
        named.withColumns({"_hash": F.xxhash64("doc_id"), "_one": F.lit(1)}),
        ["source_no", "size"], ["_hash", "doc_id"], "_one", "_rank")
    copies = (F.floor(F.col("copies") / F.col("n"))
              + (F.col("_rank") < F.col("copies") % F.col("n")).cast("long"))
    return (placed.join(stage(plan, "copies"), ["source_no", "size"])
            .withColumn("copies", copies)
            .select("doc_id", "source", "size", "source_size", "target", "rate", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source") -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it.

    Rows that repeat an id are taken alike, as often as the one taken most.
    """
    copies = (mix(docs, id_col, text_col, source_col).where("copies > 0")
              .groupBy("doc_id").agg(F.max("copies").alias("copies")))
    rows = docs.select(docs[id_col].alias("id"), F.struct(*[docs[c] for c in docs.columns])
                       .alias("row"))  # in a struct no column of theirs can clash
    return (rows.join(copies, rows.id.eqNullSafe(copies.doc_id))
            .select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .select("row.*"))
