"""The registered queries, and their SQL where DuckDB is at hand."""

import os

import pytest

import __spark_entry__ as spark_entry
from checks import oracles
from checks import queries as registered
from checks.messy import MESSY_ORDERS

SF_DIR = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_every_query_has_its_sql():
    assert set(registered.queries()) == set(oracles.oracle_sql())
    assert set(registered.queries()) <= set(spark_entry.queries())


def test_recipes_run_over_whole_tables():
    assert "limit" not in MESSY_ORDERS.lower()


@needs_data
def test_flagship(spark):
    df = spark_entry.entry(spark)
    assert df.columns == ["order_id", "status", "priority", "order_date", "amount", "urgent", "row_no"]
    assert df.count() > 0


@pytest.fixture(scope="module")
def con():
    pytest.importorskip("duckdb")
    from checks.compare import duckdb_connection

    return duckdb_connection(SF_DIR)


@needs_data
@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_query_equals_sql_and_its_plan_is_plain(spark, con, name):
    from checks.compare import differences

    assert differences(spark, con, SF_DIR, name) is None
