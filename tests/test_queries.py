"""Every core query against its SQL; those without SQL must run and keep their schema."""

import importlib

import pytest
from conftest import DATA
from oracle import compare

CORE = ("problems", "text_queries", "retrieval_queries", "extract_queries", "layout_queries", "record_queries")
QUERIES, SQL = {}, {}
for name in CORE:
    m = importlib.import_module(f"quirelake.plans.{name}")
    QUERIES |= m.QUERIES
    SQL |= m.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, spark, duck):
    assert compare(spark, duck, name, QUERIES[name], SQL[name], DATA) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark):
    df = QUERIES[name](spark, DATA)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
