import pytest

from mcqlab.plans.catalog import QUERIES, SQL
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    assert check(spark, sf_dir, QUERIES[name], SQL[name]) > 0
