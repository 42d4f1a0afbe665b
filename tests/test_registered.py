import pytest

from __spark_entry__ import entry, oracle_sql, queries
from oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, con, name):
    compare(spark, con, SF, queries()[name], oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(spark, name):
    queries()[name](spark, SF).count()


def test_entry(spark):
    assert entry(spark).count() > 0
