"""Toxicity by a weighted lexicon.

Texts are folded first: case, letters of other scripts that look Latin, digits and signs that stand
for letters, invisible characters; i, l and 1 become one letter. Accents stay, as they tell words
of other languages apart. One Aho-Corasick
automaton then finds all lexicon entries in a pass over the whole folded text. An entry is a whole
word or the beginning of words. Exception phrases are in the same automaton: an entry inside one
does not count.

The lexicon is learned: for words and word beginnings, the weight is the log odds of holding them
in toxic and in other labelled texts. A score is the logistic function of the summed weights,
normalised by length, with coefficients fitted on the same rows.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import map_arrow, stage

SAMPLE_ROWS = 12_000  # labelled texts that learning expects to take at most
PREFIXES = range(4, 8)
MIN_TEXTS = 3  # toxic texts that hold an entry, at least; of many, one in
ONE_IN = 250
MIN_PRECISION = 0.8
MAX_EXCEPTION = 0.3  # precision of a phrase that does not count

# Letters of other scripts and signs by the Latin letter they look like.
LOOKALIKES = {
    "a": "аαɑ@4", "b": "вβь8", "c": "сϲ¢",
    "d": "ԁ", "e": "еεё3€", "g": "ɡ", "h": "һн",
    "i": "іїιıӏl1|", "j": "ј", "k": "кκ",
    "m": "м", "n": "ηп", "o": "оοσ0", "p": "рρ",
    "q": "ԛ", "r": "г", "s": "ѕ$5", "t": "тτ7", "u": "υս",
    "v": "νѵ", "w": "ѡԝ", "x": "хχ", "y": "уγ",
    "z": "ƶ",
}


class _Folding(dict):
    """Character by character, filled as characters are met."""

    def __missing__(self, code: int) -> str:
        out = []
        for c in unicodedata.normalize("NFKC", chr(code).lower()):
            c = next((latin for latin, like in LOOKALIKES.items() if c in like), c)
            if c.isalpha():
                out.append(c)
            elif unicodedata.category(c) not in ("Mn", "Cf"):
                out.append(" ")
        self[code] = "".join(out)
        return self[code]


_FOLDING = _Folding()


def fold(text: str | None) -> str:
    """Folded words, each with one space before and after it."""
    return " " + " ".join((text or "").translate(_FOLDING).split()) + " "


def entries(words: list[str]) -> set[str]:
    """What may become lexicon entries: ` word ` and ` beginning`."""
    out = set()
    for word in set(words):
        out.add(f" {word} ")
        out.update(f" {word[:n]}" for n in PREFIXES if len(word) > n)
    return out


class Lexicon(NamedTuple):
    """Weights by entry, exception phrases, and the coefficients of the score.

    The score is logistic(intercept + by_density * density + by_sum * log(1 + sum)), the sum of
    the weights of entries in a text and the density per square root of its words.
    """

    weights: dict[str, float]
    exceptions: frozenset[str]
    coefficients: tuple[float, float, float]


class Scorer:
    def __init__(self, lexicon: Lexicon):
        self.coefficients = np.array(lexicon.coefficients)
        self.automaton = ahocorasick.Automaton()
        for entry, weight in lexicon.weights.items():
            self.automaton.add_word(entry, (len(entry), weight))
        for phrase in lexicon.exceptions:
            self.automaton.add_word(phrase, (len(phrase), None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def features(self, text: str | None) -> tuple[float, float]:
        """(density, log of sum); a word counts once, by its heaviest entry."""
        folded = fold(text)
        found: dict[int, float] = {}
        covered: list[tuple[int, int]] = []
        if len(self.automaton):
            for end, (length, weight) in self.automaton.iter(folded):
                begin = end - length + 1
                if weight is None:
                    covered.append((begin, end))
                else:
                    found[begin] = max(weight, found.get(begin, 0.0))
        if covered and found:
            found = {at: w for at, w in found.items()
                     if not any(a <= at < b for a, b in covered)}
        total = sum(found.values())
        return total / max(1, folded.count(" ") - 1) ** 0.5, float(np.log1p(total))

    def score(self, text: str | None) -> float:
        density, total = self.features(text)
        return float(_logistic(self.coefficients @ (1.0, density, total)))


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic",
          key_col: str = "doc_id", rows: int = SAMPLE_ROWS) -> Lexicon:
    """A lexicon from about `rows` of the `labels`, half of them toxic if there are enough.

    They are chosen by a hash of the key, alike in every run, before any text is read; being so
    few, their keys are broadcast to the texts in `docs`. Texts are counted where they lie; only
    entries in the lexicon and two numbers a text reach the driver. The lexicon holds every entry
    that is precise and in enough toxic texts, MIN_TEXTS and one in ONE_IN of them: in a larger
    sample more words stand in a few toxic texts by chance. Null keys and labels are left
    out; of several labels of a key the largest counts. Without toxic texts the lexicon is empty.
    """
    flags = labels.where(F.col(label_col).isNotNull() & F.col(key_col).isNotNull()).groupBy(
        F.col(key_col).alias("_key")).agg((F.max(label_col) == 1).alias("toxic")).withColumn(
        "_hash", F.pmod(F.xxhash64("_key", F.lit("toxicity")), F.lit(1 << 40)))
    counts = flags.groupBy("toxic").agg(F.count("*").alias("n")).collect()
    share = {r.toxic: min(1.0, rows / 2 / r.n) for r in counts}
    chosen = flags.where(F.col("_hash") < F.when(
        F.col("toxic"), int(share.get(True, 0) * (1 << 40)))
        .otherwise(int(share.get(False, 0) * (1 << 40)))).select("_key", "toxic")
    sample = stage(
        docs.select(F.col(key_col).alias("_key"), F.col(text_col).alias("text"))
        .join(F.broadcast(chosen), "_key").select("text", "toxic"), "labelled")
    texts = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, other = texts.get(True, 0), texts.get(False, 0)
    if not toxic or not other:
        return Lexicon({}, frozenset(), (float(np.log((toxic + 1) / (other + 1))), 0.0, 0.0))

    counted = _count(sample)
    odds = (F.log((F.col("a") + 0.5) / (toxic - F.col("a") + 0.5))
            - F.log((F.col("b") + 0.5) / (other - F.col("b") + 0.5)))
    precise = (F.col("a") / toxic) >= MIN_PRECISION * (F.col("a") / toxic + F.col("b") / other)
    kept = (counted.where((F.col("a") >= min(max(MIN_TEXTS, toxic / ONE_IN), toxic)) & precise)
            .select("entry", odds.alias("weight")).collect())
    weights = _without_longer({r.entry: r.weight for r in kept if r.weight > 0})
    exceptions = _exceptions(sample, weights, toxic, other)
    share = (share[True], share[False])
    return Lexicon(weights, exceptions, _fit(sample, Lexicon(weights, exceptions, (0, 0, 0)),
                                             share))


def _count(sample: DataFrame) -> DataFrame:
    """(entry, a, b): texts that hold it, toxic and other. Tasks add up before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {True: Counter(), False: Counter()}

        def out():
            names = list(seen[True].keys() | seen[False].keys())
            batch = pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([seen[True][n] for n in names], pa.int64()),
                 pa.array([seen[False][n] for n in names], pa.int64())], names=["entry", "a", "b"])
            seen[True].clear()
            seen[False].clear()
            return batch

        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(),
                                   batch.column("toxic").to_pylist()):
                seen[toxic].update(entries(fold(text).split()))
                if len(seen[True]) + len(seen[False]) > 200_000:
                    yield out()
        yield out()

    return (sample.mapInArrow(run, "entry string, a long, b long")
            .groupBy("entry").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))


def _without_longer(weights: dict[str, float]) -> dict[str, float]:
    """Without entries that a shorter one finds too, unless they weigh clearly more."""
    out = {}
    for entry in sorted(weights, key=len):
        shorter = [out[entry[:n + 1]] for n in PREFIXES
                   if n + 1 < len(entry) and entry[:n + 1] in out]
        if not shorter or weights[entry] > max(shorter) + 1:
            out[entry] = weights[entry]
    return out


def _exceptions(sample: DataFrame, weights: dict[str, float], toxic: int,
                other: int) -> frozenset[str]:
    """Words and pairs of words that hold an entry but mostly stand in texts that aren't toxic."""
    def step(cols):
        scorer = Scorer(Lexicon(weights, frozenset(), (0, 0, 0)))
        phrases, flags = [], []
        for text, flag in zip(cols["text"].to_pylist(), cols["toxic"].to_pylist()):
            words = fold(text).split()
            if len(scorer.automaton) and scorer.features(text)[1] > 0:
                hit = [any(True for _ in scorer.automaton.iter(f" {w} ")) for w in words]
                own = {f" {w} " for w, h in zip(words, hit) if h}
                own |= {f" {a} {b} " for a, b, x, y in zip(words, words[1:], hit, hit[1:])
                        if x or y}
                phrases += own
                flags += [flag] * len(own)
        return {"phrase": phrases, "toxic": flags}

    precision = (F.col("a") / toxic) / (F.col("a") / toxic + F.col("b") / other)
    rows = (map_arrow(sample, "phrase string, toxic boolean", step).groupBy("phrase")
            .agg(F.sum(F.col("toxic").cast("int")).alias("a"),
                 F.sum((~F.col("toxic")).cast("int")).alias("b"))
            .where((F.col("b") >= MIN_TEXTS) & (precision <= MAX_EXCEPTION))
            .select("phrase").collect())
    return frozenset(r.phrase for r in rows)


def _fit(sample: DataFrame, lexicon: Lexicon, share: tuple[float, float]):
    """Coefficients of the score, by Newton's method with a small ridge."""
    def step(cols):
        scorer = Scorer(lexicon)
        found = [scorer.features(t) for t in cols["text"].to_pylist()]
        return {"density": [f[0] for f in found], "total": [f[1] for f in found],
                "toxic": cols["toxic"]}

    rows = sorted(map_arrow(sample, "density double, total double, toxic boolean", step).collect())
    x = np.array([(1.0, r.density, r.total) for r in rows])
    y = np.array([float(r.toxic) for r in rows])
    weight = np.where(y > 0, 1 / share[0], 1 / share[1])  # classes as often as they were
    weight = weight / weight.mean()
    b = np.zeros(3)
    for _ in range(50):
        p = _logistic(x @ b)
        hessian = (x.T * (weight * p * (1 - p))) @ x + np.diag((1e-6, 0.1, 0.1))
        change = np.linalg.solve(hessian, x.T @ (weight * (y - p)) - np.array((0, 0.1, 0.1)) * b)
        b = b + np.clip(change, -5, 5)
        if np.abs(change).max() < 1e-9:
            break
    return tuple(b.tolist())


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(id, score) per row. A null or empty text has the score of a text without entries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in batches:
            values = [scorer.score(t) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col),
                                              pa.array(values, pa.float64())],
                                             names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).alias("_text")).mapInArrow(
        run, f"`{id_col}` {kind}, score double")
