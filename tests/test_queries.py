"""Every registered query against the same query in SQL."""

import oracle
import pytest

import __spark_entry__

SF_DIR = "/root/testdata/sf0.001"
QUERIES = __spark_entry__.queries()
SQL = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(SF_DIR)


OPTIONAL = {name for module in __spark_entry__._optional() for name in module.queries()}


def test_every_query_has_sql():
    assert set(QUERIES) - OPTIONAL <= set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - OPTIONAL))
def test_query(spark, connection, name):
    assert oracle.compare(QUERIES[name](spark, SF_DIR), connection, SQL[name]) is None


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["event_id", "sub_id", "topic", "value"]
