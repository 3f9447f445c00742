"""The driver's contract."""

import os

import pytest

import __spark_entry__ as entry


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert all(callable(q) for q in queries.values()) and all(isinstance(s, str) and s.strip() for s in sql.values())
    assert len(queries) >= 95


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["doc_id", "source", "priority"] and rows.count() > 0
