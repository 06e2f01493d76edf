"""Rows of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa

ROWS = 50  # of a batch, turned into Python objects at once


def each_row(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[dict[str, Any]]:
    """Rows as dicts; few are Python objects at a time, however many and wide a batch's rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield from batch.slice(at, rows).to_pylist()
