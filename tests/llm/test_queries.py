"""Registered queries of the corpus operators that SQL can express."""

import os

import pytest

from recordgauge.llm.queries import oracle_sql, queries
from tests.oracle import connect, spark_result, sql_result

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    rows = spark_result(queries()[name](spark, SF_DIR))
    assert rows == sql_result(connect(SF_DIR), oracle_sql()[name])
    assert rows[1]
