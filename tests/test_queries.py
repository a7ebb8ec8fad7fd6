import pytest

import __spark_entry__ as registered
from tests.check_oracle import compare, connect
from tests.conftest import SF_DIR
from workload.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def database():
    return connect(SF_DIR)


def test_entry(spark):
    found = registered.entry(spark)
    assert found.groupBy("rule_id").count().count() == 78


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, database, name):
    n, difference, _ = compare(spark, database, SF_DIR, name, registered.queries()[name], registered.oracle_sql().get(name))
    assert difference is None
    assert n >= 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
