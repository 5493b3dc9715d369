"""Every query of the engine against its DuckDB statement."""

import os

import pytest

from lexloom import catalogue
from tests.oracle import connection, duck_rows, spark_rows

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
Q, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(Q))
def test_query(spark, con, name):
    cols, got = spark_rows(Q[name](spark, SF))
    assert cols
    if name in SQL:
        want_cols, want = duck_rows(con, SQL[name])
        assert cols == want_cols
        assert got == want
