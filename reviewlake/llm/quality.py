"""Quality by weak supervision.

Rules look at simple counts of a text and vote good, bad, or abstain. Nobody knows which rules to
trust, so expectation-maximisation estimates, from agreement over all documents, how often each
rule is right and how many documents are good; a document is kept by the posterior probability
that it is good. Bad documents are of several kinds, one per rule to begin with: a text full of
symbols may well have no repeated line, and rules that miss a defect they don't look for are not
wrong. A rule is right more often than not on good documents and on its own kind of bad ones,
which keeps the kinds in their places.

All that the estimation needs is how often every combination of votes occurs: one grouped count
over all documents, of at most 3 ** rules rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import map_arrow, stage, utf8

WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED = 20  # percent of words
LONG = 20_000  # words of a text whose windows are numbers instead of lists
SYMBOLS = b"#*$%&|<>"
PRIOR = 0.8  # share of good documents that estimation starts with
FIRST_WRONG = 0.03  # how often a rule is taken to be wrong at first
MOST_WRONG = 0.2
ROUNDS = 300
KEEP_AT = 0.5
_NO_POINT = bytes(range(0x80, 0xC0)) + b" \t\n\r\x0b\x0c"


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
          "n_ended", "n_adjacent")


def counts(data: bytes | None) -> tuple[int, ...]:
    """COUNTS of a text: words, code points in words, symbols, repeated lines, words in repeated
    windows, lines with a word, those that end a sentence, words equal to the one before."""
    data = data or b""
    words = data.split()
    points = len(data.translate(None, _NO_POINT))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.strip()]
    ended = sum(line.rstrip()[-1:] in b".!?\"" for line in lines)
    return (len(words), points, symbols, len(lines) - len(set(lines)), repeated_words(words),
            len(lines), ended, sum(map(bytes.__eq__, words, words[1:])))


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of `width` words found twice or more."""
    if len(words) > LONG:
        return _repeated_in_long(words, width)
    windows = list(zip(*(words[i:] for i in range(width))))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    covered, end = 0, 0
    for i, window in enumerate(windows):
        if often[window] > 1:
            covered += i + width - max(i, end)
            end = i + width
    return covered


def _repeated_in_long(words: list[bytes], width: int) -> int:
    """The same with a few numbers a word: windows are numbered word by word, equal ones alike."""
    numbers: dict[bytes, int] = {}
    word = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    window, counts = word, None
    for k in range(1, width):
        code = window[:len(word) - k] * len(numbers) + word[k:]
        _, window, counts = np.unique(code, return_inverse=True, return_counts=True)
    inside = np.zeros(len(word) + 1, np.int64)
    often = np.flatnonzero(counts[window] > 1)
    np.add.at(inside, often, 1)
    np.add.at(inside, often + width, -1)
    return int((np.cumsum(inside) > 0).sum())


def _between(value: Column, bad_below: float, good: tuple[float, float], bad_above: float) -> Column:
    return (F.when((value < bad_below) | (value > bad_above), -1)
            .when(value.between(*good), 1).otherwise(0))


def _per(count: str, of: str) -> Column:
    return F.col(count) / F.greatest(F.col(of), F.lit(1))


# name -> vote: 1 good, -1 bad, 0 abstains
RULES: dict[str, Callable[[], Column]] = {
    "length": lambda: _between(F.col("n_words"), 10, (40, 20_000), 200_000),
    "word_length": lambda: _between(_per("word_chars", "n_words"), 2.0, (3, 9), 14.0),
    "symbols": lambda: _between(_per("n_symbols", "n_words"), 0, (0, 0.02), 0.15),
    "lines_repeated": lambda: _between(_per("n_dup_lines", "n_lines"), 0, (0, 0.05), 0.4),
    "words_repeated": lambda: _between(_per("n_repeat_words", "n_words"), 0, (0, 0.02), 0.2),
    "words_doubled": lambda: _between(_per("n_adjacent", "n_words"), 0, (0, 0.05), 0.25),
    "sentences": lambda: F.when(F.col("n_lines") == 0, -1).otherwise(
        _between(_per("n_ended", "n_lines"), 0.1, (0.5, 1), 1)),
}


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts of every row, and whether it fails the base rules. Null is an empty text."""
    def step(cols):
        rows = np.array([counts(v.as_py()) for v in cols["_text"]], np.int64)
        return {id_col: cols[id_col], **dict(zip(COUNTS, rows.T))}

    kind = docs.schema[id_col].dataType.simpleString()
    found = map_arrow(docs.select(id_col, utf8(text_col).alias("_text")),
                      f"`{id_col}` {kind}, " + ", ".join(f"{n} long" for n in COUNTS), step)
    return found.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))


class Model(NamedTuple):
    """Shares of kinds (good ones first, then a bad kind per rule), and by kind and rule how often
    a vote of the rule is a bad one."""

    shares: np.ndarray
    bad_votes: np.ndarray

    def log_odds(self, patterns: np.ndarray) -> np.ndarray:
        """Log of the weight of every kind, one row per pattern of votes; abstentions say nothing."""
        return (np.log(self.shares) + (patterns < 0) @ np.log(self.bad_votes).T
                + (patterns > 0) @ np.log(1 - self.bad_votes).T)


def first_guess(rules: int) -> Model:
    shares = np.array([PRIOR] + [(1 - PRIOR) / rules] * rules)
    bad_votes = np.full((rules + 1, rules), FIRST_WRONG)
    bad_votes[range(1, rules + 1), range(rules)] = 1 - FIRST_WRONG
    return Model(shares, bad_votes)


def estimate(patterns: np.ndarray, counted: np.ndarray) -> Model:
    """The model most likely to have given vote patterns with these counts.

    One imagined document of every kind that votes as at first keeps all rates off 0 and 1.
    """
    rules = patterns.shape[1]
    start = model = first_guess(rules)
    for _ in range(ROUNDS):
        weight = _shares(model.log_odds(patterns)) * counted[:, None]
        bad = weight.T @ (patterns < 0) + start.bad_votes
        votes = weight.T @ (patterns != 0) + 1
        rates = bad / votes
        rates[0] = np.minimum(rates[0], MOST_WRONG)
        own = rates[range(1, rules + 1), range(rules)]
        rates[range(1, rules + 1), range(rules)] = np.maximum(own, 1 - MOST_WRONG)
        shares = weight.sum(axis=0) + start.shares
        new = Model(shares / shares.sum(), rates)
        moved = max(np.abs(new.shares - model.shares).max(), np.abs(rates - model.bad_votes).max())
        model = new
        if moved < 1e-9:
            break
    return model


def _shares(logs: np.ndarray) -> np.ndarray:
    weight = np.exp(logs - logs.max(axis=1, keepdims=True))
    return weight / weight.sum(axis=1, keepdims=True)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts, base_failed, quality, kept) per row.

    quality is the posterior probability of a good document; kept needs at least KEEP_AT and that
    the base rules don't fail. An empty table gives no rows.
    """
    voted = stage(measure(docs, id_col, text_col).withColumns(
        {f"_{name}": rule().cast("int") for name, rule in RULES.items()}), "votes")
    rules = [f"_{name}" for name in RULES]
    found = voted.groupBy(*rules).count().collect()  # at most 3 ** len(RULES) rows
    model = first_guess(len(rules))
    if found:
        table = np.array([tuple(r) for r in sorted(found)], np.float64)
        model = estimate(table[:, :-1], table[:, -1])
    kinds = []
    for share, rates in zip(model.shares.tolist(), model.bad_votes.tolist()):
        log = F.lit(float(np.log(share)))
        for rule, rate in zip(rules, rates):
            log = log + F.when(F.col(rule) < 0, float(np.log(rate))).when(
                F.col(rule) > 0, float(np.log(1 - rate))).otherwise(0.0)
        kinds.append(F.exp(log))
    quality = kinds[0] / sum(kinds[1:], kinds[0])
    return voted.withColumn("quality", quality).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_AT)).select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "quality", "kept")
