"""Language identification in two steps: family first, then the languages within it.

Texts are hashed byte trigrams of their lower-cased letters, as square roots of frequencies. Both
steps are one-versus-one linear support vector machines, trained here by dual coordinate descent
on a bounded sample of labelled rows. Scoring reads every whole text and ships nothing but the
weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import map_arrow, stage

UNDETERMINED = "und"
BUCKETS = 1 << 13
PER_LANGUAGE = 250  # labelled texts that training expects to take of each language
EPOCHS = 30
STEEPNESS = 3.0  # of the curve from margins to probabilities

# Language codes by family.
FAMILIES = {
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "hellenic": "el",
    "indic": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "romance": "ca es fr gl it la oc pt ro",
    "semitic": "am ar he mt",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "turkic": "az kk ky tr tt ug uz",
    "uralic": "et fi hu",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_LETTER = re.compile(r"[^\W\d_]")  # and some numbers: superscripts, fractions, numerals
_LETTERS_ONLY = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def family(lang: str) -> str:
    """The family of a code; a code not in the table is a family of its own."""
    return FAMILY.get(re.split("[-_]", lang.lower())[0], lang)


def trigrams(text: str | None) -> np.ndarray | None:
    """Buckets of all byte trigrams; None if the text is null or has no letter."""
    if not text or not any(m[0].isalpha() for m in _LETTER.finditer(text)):
        return None
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "replace")
                         .translate(_LETTERS_ONLY) + b" ", np.uint8).astype(np.uint32)
    mixed = (data[:-2] * 0x01000193 ^ data[1:-1]) * 0x01000193 ^ data[2:]
    return (mixed * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)


def features(text: str | None) -> np.ndarray | None:
    found = trigrams(text)
    if found is None:
        return None
    counts = np.bincount(found, minlength=BUCKETS)
    return np.sqrt(counts / len(found)).astype(np.float32)


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, seed: int = 7) -> np.ndarray:
    """Weights of a linear support vector machine (hinge loss), bias last. y holds -1 and 1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]) if len(x) else x
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1], np.float32)
    norms = (x * x).sum(axis=1)
    upper = np.where(y > 0, len(y) / (2 * max((y > 0).sum(), 1)),
                     len(y) / (2 * max((y < 0).sum(), 1))) * cost * 10  # classes weigh alike
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(x)):
            gradient = y[i] * float(x[i] @ w) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), upper[i])
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                alpha[i] = new
    return w


class OneVersusOne:
    """A machine for every pair of classes; the class with the most votes wins.

    Ties go to the class with the larger sum of margins. The score is the winner's smallest
    probability against any other class; 1 if it is the only class.
    """

    def __init__(self, x: np.ndarray, labels: list[str]):
        self.classes = sorted(set(labels))
        names = np.array(labels)
        self.pairs = list(combinations(range(len(self.classes)), 2))
        weights = []
        for a, b in self.pairs:
            rows = np.flatnonzero((names == self.classes[a]) | (names == self.classes[b]))
            weights.append(train_svm(x[rows], np.where(names[rows] == self.classes[a], 1, -1)))
        self.weights = np.array(weights, np.float32)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        if not self.pairs:
            return self.classes[0], 1.0
        margins = self.weights[:, :-1] @ x + self.weights[:, -1]
        votes = np.zeros((len(self.classes), 2))
        for (a, b), m in zip(self.pairs, margins.tolist()):
            votes[a if m >= 0 else b, 0] += 1
            votes[a, 1] += m
            votes[b, 1] -= m
        best = max(range(len(votes)), key=lambda c: tuple(votes[c]))
        against = [m if a == best else -m for (a, b), m in zip(self.pairs, margins.tolist())
                   if best in (a, b)]
        return self.classes[best], float(1 / (1 + np.exp(-STEEPNESS * min(against))))


class Model:
    """Machines for the families, and within each family for its languages."""

    def __init__(self, x: np.ndarray, labels: list[str]):
        families = [family(lang) for lang in labels]
        self.top = OneVersusOne(x, families) if labels else None
        self.within = {f: OneVersusOne(x[[i for i, g in enumerate(families) if g == f]],
                                       [l for l, g in zip(labels, families) if g == f])
                       for f in set(families)}

    def predict(self, text: str | None) -> tuple[str, float]:
        x = features(text)
        if x is None or self.top is None:
            return UNDETERMINED, 0.0
        chosen, sure = self.top.predict(x)
        lang, surer = self.within[chosen].predict(x)
        return lang, sure * surer


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang",
          key_col: str = "doc_id", per_language: int = PER_LANGUAGE) -> Model:
    """A model learned from about `per_language` rows of each language.

    Rows are chosen by a hash of their key against a threshold from the language's count, so that
    the choice is the same in every run. Only their features reach the driver: at most BUCKETS
    numbers a row, whatever the length of the text. Rows with a null language are left out.
    """
    rows = labelled.where(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
        F.pmod(F.xxhash64(F.col(key_col), F.lit("language")), F.lit(1 << 40)).alias("_hash"))
    counts = stage(rows.groupBy("lang").agg(F.count("*").alias("_n")), "languages")
    # divided, not multiplied: a hash times a count of over 2**23 rows is no longer a long
    chosen = rows.join(counts, "lang").where(
        F.col("_hash") < F.lit(float(per_language << 40)) / F.col("_n"))

    def step(cols):
        found = [(lang, features(t)) for lang, t in zip(cols["lang"].to_pylist(),
                                                        cols["text"].to_pylist())]
        found = [(lang, x) for lang, x in found if x is not None]
        return {"lang": [lang for lang, _ in found],
                "at": [np.flatnonzero(x).tolist() for _, x in found],
                "x": [x[x > 0].tolist() for _, x in found]}

    sample = sorted(map_arrow(chosen.select("lang", "text"),
                              "lang string, at array<int>, x array<double>", step).collect())
    x = np.zeros((len(sample), BUCKETS), np.float32)
    for i, row in enumerate(sample):
        x[i, row.at] = row.x
    return Model(x, [row.lang for row in sample])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) per row: `und` and 0 for a text that is null or has no letter.

    Also `und` for every row if no labelled text was there to learn from.
    """
    def step(cols):
        found = [model.predict(t) for t in cols["_text"].to_pylist()]
        return {id_col: cols[id_col], "lang_pred": [f[0] for f in found],
                "score": [f[1] for f in found]}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, F.col(text_col).alias("_text")),
                     f"`{id_col}` {kind}, lang_pred string, score double", step)


def identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose language the model names; those it calls `und` go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = [model.predict(t)[0] != UNDETERMINED
                     for t in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array(named, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
