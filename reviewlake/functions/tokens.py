"""Token counts of the text a block contributes to a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block_text(path: str = "file_path", line: str = "line_number", name: str = "name",
               code: str = "code") -> Column:
    """The text whose tokens are counted; its fence says python for every language."""
    return F.concat(
        F.lit("\nFile: "), F.col(path), F.lit(" | Line: "), F.col(line).cast("string"),
        F.lit(" | Function: "), F.col(name), F.lit("\n```python\n"), F.col(code),
        F.lit("\n```\n"),
    )


def count_chars4(text: Column) -> Column:
    """Estimate: one token per four characters, rounded up."""
    return F.ceil(F.length(text) / F.lit(4)).cast("long")


def with_tokens(blocks: DataFrame,
                encoder: Callable[[], Callable[[str], list[int]]] | None = None) -> DataFrame:
    """Add `tokens`.

    Without `encoder` this is the native estimate. `encoder` is a factory called once per
    Python worker that returns an exact encode function, e.g.
    `lambda: tiktoken.get_encoding("cl100k_base").encode`.
    """
    if encoder is None:
        return blocks.withColumn("tokens", count_chars4(block_text()))

    @F.pandas_udf("long")
    def exact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder()
        for texts in batches:
            yield texts.map(lambda t: len(encode(t)))

    return blocks.withColumn("tokens", exact(block_text()))
