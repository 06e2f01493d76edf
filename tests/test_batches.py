from __future__ import annotations

import tracemalloc

import pyarrow as pa

from reviewlake.functions.batches import each_row


def test_a_wide_batch_is_not_turned_into_text_at_once():
    batch = pa.RecordBatch.from_pylist([{"i": i, "text": f"{i}" * 20_000} for i in range(1000)])
    tracemalloc.start()
    assert [r["i"] for r in each_row(iter([batch, batch]))] == [*range(1000)] * 2
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < batch.nbytes / 4


def test_no_rows():
    assert list(each_row(iter([pa.RecordBatch.from_pylist([], pa.schema([("i", pa.int64())]))]))) == []
