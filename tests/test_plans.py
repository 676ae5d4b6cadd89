import pytest
import verify
from millrace.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return verify.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    assert verify.compare(QUERIES[name](spark, SF), con, ORACLE_SQL[name]) == ""
