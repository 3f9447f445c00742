"""Every query of the library against DuckDB on the smallest tables."""

import os

import pytest
from compare import duck, duck_rows, spark_rows

from dossier import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, db, name):
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = spark_rows(df, columns)
    if name in SQL:
        assert rows == duck_rows(db, SQL[name], columns)
    else:
        assert rows


def test_every_sql_has_a_query():
    assert set(SQL) <= set(queries.queries())
