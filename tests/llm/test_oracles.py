import pytest

from tests.comparing import same
from tidemark.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, medium, name):
    same(QUERIES[name], ORACLE_SQL[name], spark, medium)
