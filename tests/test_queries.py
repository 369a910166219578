"""Every registered query of the archive against its SQL."""

import pytest

import __spark_entry__
from tests.comparing import same
from tidemark.plans.catalog import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, small, name):
    same(QUERIES[name], ORACLE_SQL[name], spark, small)


def test_every_query_is_registered():
    assert QUERIES.keys() <= __spark_entry__.queries().keys() and ORACLE_SQL.keys() <= __spark_entry__.oracle_sql().keys()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns
