"""Queries against their SQL on the smallest tables; the others only run."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import compare  # noqa: E402

from reviewlake.llm.queries import QUERIES  # noqa: E402


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, name):
    query = QUERIES[name]
    frame = query.run(spark, sf_dir)
    ours = frame.toPandas()
    assert len(ours)
    if query.sql is not None:
        duck = compare.connect(sf_dir)
        assert compare.differences(ours, duck.execute(query.sql).fetchdf()) is None
        assert compare.type_differences(frame, duck, query.sql) == ""
