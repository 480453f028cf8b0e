"""The driver contract, and every registered query against its DuckDB oracle on
the smallest driver tables."""

import os

import pytest

import __spark_entry__ as E
from larder.plans import catalog
from larder.plans.compare import compare, duck_connection

SMOKE = "/root/testdata/sf0.001"
have_data = os.path.isdir(SMOKE)


@pytest.mark.skipif(not have_data, reason="driver tables absent")
def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["item_id", "name", "quantity", "unit", "expiry_date", "days_left", "category", "location"]


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) <= set(E.queries())
    assert set(catalog.QUERIES) == set(E.oracle_sql()) & set(catalog.QUERIES)


@pytest.mark.skipif(not have_data, reason="driver tables absent")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_oracle(spark, name):
    con = duck_connection(SMOKE)
    res = compare(E.queries()[name](spark, SMOKE), con, E.oracle_sql()[name])
    assert res["schema_match"] and res["values_match"], res
