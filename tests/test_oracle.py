"""Every query with SQL gives the SQL's rows; the others give rows."""

import pytest

import __spark_entry__ as entry
from tests import oracle

SF = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    if name in ORACLE:
        assert oracle.compare(df, con, ORACLE[name]) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 31
