import pytest

from sectionlens.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import differences, small


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert differences(spark, QUERIES[name], ORACLE_SQL[name], small()) == ""
