"""Every query gives the rows of its SQL in DuckDB."""

import pytest
from oracle import compare

from sluice.plans.catalog import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, sf, name):
    compare(QUERIES[name](spark, sf), ORACLE_SQL[name], sf)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
