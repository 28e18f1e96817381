"""Every catalogue query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect
from tablewright.session import release

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert compare(duck, df, ORACLES[name]) is None
    else:
        assert df.count() > 0
    release()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["part", "column", "metric", "value"]
    assert df.count() > 100
