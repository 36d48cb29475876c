"""Corpus queries that SQL can express, against it."""

import pytest

from tessera.llm import queries
from tests.test_queries import rows

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, data, name):
    ours, theirs = queries.queries()[name](spark, data).toPandas(), duck.sql(SQL[name]).to_arrow_table().to_pandas()
    assert rows(ours) == rows(theirs)
