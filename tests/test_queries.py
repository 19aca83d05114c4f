import pytest

from __spark_entry__ import entry, oracle_sql, queries
from noticeflow.checks.compare import compare
from noticeflow.checks.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, sf_dir, name):
    assert name in queries() and name in oracle_sql()
    assert compare(spark, sf_dir, name) is None


def test_entry(spark):
    assert entry(spark).count() > 0
