import pytest

from __spark_entry__ import entry, oracle_sql, queries
from oracle import connect, difference
from workload.registry import QUERIES

SF = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_of_the_library_has_a_twin():
    assert set(QUERIES) <= set(SQL) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_twin(spark, con, name):
    result = difference(queries()[name](spark, SF), con, SQL[name])
    assert result is None, result


def test_entry(spark):
    df = entry(spark)
    assert len(df.columns) == 21 and df.count() > 0
