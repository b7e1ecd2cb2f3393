"""Every registered query of the workbench against its SQL, on the smallest tables."""

import pytest

from tablewright.plans import catalog
from tests import oracle
from tests.conftest import SF

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert oracle.given(QUERIES[name](spark, SF)) == oracle.expected(SF, SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
