"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

import compare
from reviewlake.plans.queries import QUERIES

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.connect(TABLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    query = QUERIES[name]
    frame = query.run(spark, TABLES)
    ours = frame.toPandas()
    if query.sql is None:
        return
    assert compare.differences(ours, duck.execute(query.sql).fetchdf()) is None
    assert compare.type_differences(frame, duck, query.sql) == ""


def test_entry_contract(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
