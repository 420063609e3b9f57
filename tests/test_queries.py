import os

import pytest

import __spark_entry__ as registered
from tests.oracle import connect, spark_result, sql_result

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def _of_records(name):
    """Whether a query is the record check's and not one of the corpus operators'."""
    return not name.startswith("op") and name != "pipeline"


def test_every_query_of_the_record_check_has_sql():
    assert {n for n in registered.queries() if _of_records(n)} == {
        n for n in registered.oracle_sql() if _of_records(n)
    }


@pytest.mark.parametrize("name", [n for n in registered.queries() if _of_records(n)])
def test_query_equals_sql(spark, con, name):
    columns, rows = spark_result(registered.queries()[name](spark, SF_DIR))
    assert (columns, rows) == sql_result(con, registered.oracle_sql()[name])
    assert rows


@pytest.mark.parametrize("name", [n for n in registered.queries() if _of_records(n)])
def test_no_query_deals_rows_out(spark, name):
    text = registered.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" not in text and "Python" not in text


def test_entry(spark):
    assert registered.entry(spark).columns == ["problem", "n_records", "n_occurrences"]
    assert registered.entry(spark).count() > 0
