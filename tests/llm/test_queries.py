import pytest

from orrery.llm import queries
from tests.conftest import same_as_sql


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, duck, data, name):
    same_as_sql(spark, duck, data, queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, data, name):
    queries.QUERIES[name](spark, data).collect()
