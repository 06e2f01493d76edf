"""Redaction of secrets by an ordered list of patterns."""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACE


class Secret(NamedTuple):
    name: str
    pattern: str
    replacement: str
    needles: tuple[str, ...]  # every match contains one of them; folded if `lowered`
    lowered: bool = False


# Name, pattern and replacement, applied in this order, each on the output of the
# one before. Flags: i = any case, u/U = Unicode classes, d = only \n ends a line.
SECRET_PATTERNS = (
    Secret("openai_key", r"sk-[a-zA-Z0-9]{20,}", "[OPENAI_KEY_REDACTED]", ("sk-",)),
    Secret("aws_key", r"AKIA[0-9A-Z]{16}", "[AWS_KEY_REDACTED]", ("AKIA",)),
    Secret(
        "aws_secret", r"(?iudU)(aws.{0,20}secret.{0,20})['\"][0-9a-zA-Z/+]{40}['\"]",
        "$1[AWS_SECRET_REDACTED]", ("aws",), lowered=True),
    Secret(
        "assignment",
        r"(?iudU)(api[_-]?key|token|secret|password|passwd|pwd)"
        rf"{SPACE}*={SPACE}*['\"][^'\"]{{20,}}['\"]",
        "$1=[REDACTED]", ("api", "token", "secret", "passw", "pwd"),
        lowered=True),
    Secret("github_token", r"ghp_[a-zA-Z0-9]{36}", "[GITHUB_TOKEN_REDACTED]", ("ghp_",)),
    Secret("bearer", rf"(?dU)Bearer{SPACE}+[a-zA-Z0-9\-._~+/]{{20,}}", "Bearer [TOKEN_REDACTED]",
           ("Bearer",)),
)


# Characters that match an ASCII letter under (?iu) but do not become it in lower case.
_LIKE_LETTERS = ("\u0131\u0130\u017f\u212a", "iisk")


def has_needle(text: Column, secret: Secret) -> Column:
    """Whether `text` holds a needle, which every match of the secret needs."""
    folded = F.lower(F.translate(text, *_LIKE_LETTERS)) if secret.lowered else text
    return reduce(or_, [folded.contains(n) for n in secret.needles])


def scrub_secrets(code: Column) -> Column:
    """The redaction as one expression, for small inputs; see `scrub`."""
    for secret in SECRET_PATTERNS:
        code = F.regexp_replace(code, secret.pattern, secret.replacement)
    return code


def _step(df: DataFrame, secret: Secret, count: bool) -> DataFrame:
    """Apply one pattern to `_text`, and count its matches first if asked to.

    Text without a needle skips the regular expression, which costs far more than a substring
    search. Each step is a projection of its own, so the text before it is computed once.
    """
    text = F.col("_text")
    possible = F.col("_possible")
    df = df.withColumn("_possible", has_needle(text, secret))
    columns = {"_text": F.when(possible, F.regexp_replace(text, secret.pattern, secret.replacement))
               .otherwise(text)}
    if count:
        columns[secret.name] = F.when(
            possible, F.regexp_count(text, F.lit(secret.pattern))).otherwise(0).cast("long")
    return df.withColumns(columns).drop("_possible")


def scrub(df: DataFrame, col: str = "code") -> DataFrame:
    """Redact every secret in `col`."""
    names = df.columns
    df = df.withColumnRenamed(col, "_text")
    for secret in SECRET_PATTERNS:
        df = _step(df, secret, count=False)
    return df.withColumnRenamed("_text", col).select(*names)


def secret_hits(df: DataFrame, col: str = "code", by: list[str] | None = None) -> DataFrame:
    """Number of matches per pattern, each counted on text the earlier patterns already cleaned.

    One pass over the text; six numbers per row reach the sums, which combine before a shuffle.
    """
    keys = by or []
    names = [secret.name for secret in SECRET_PATTERNS]
    df = df.select(*keys, F.col(col).alias("_text"))
    for secret in SECRET_PATTERNS:
        df = _step(df, secret, count=True)
    sums = df.groupBy(*keys).agg(
        *[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in names])
    return sums.unpivot(keys, names, "pattern", "hits")
