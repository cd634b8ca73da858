"""Every query of the core against its SQL, or that it runs."""

import pytest

from orrery import fixture_queries, general_queries, reference_queries
from tests.conftest import same_as_sql

QUERIES = general_queries.QUERIES | reference_queries.QUERIES | fixture_queries.QUERIES
ORACLES = general_queries.ORACLES | reference_queries.ORACLES | fixture_queries.ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, duck, data, name):
    same_as_sql(spark, duck, data, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_else_imports_llm():
    import subprocess

    found = subprocess.run(["grep", "-rlE", r"orrery\.llm|from \.llm|import llm", "orrery", "--include=*.py"], capture_output=True, text=True).stdout.split()
    assert all(f.startswith("orrery/llm/") for f in found)
