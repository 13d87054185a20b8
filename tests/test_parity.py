"""Every registered query against its DuckDB twin (row count, columns, values)."""

import pytest

import __spark_entry__ as entry
from shopscope.plans.oracle import SQL
from shopscope.plans.queries import QUERIES
from tests.conftest import SMALL
from tests.parity import compare, duck


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_twin(spark, con, name):
    r = compare(spark, SMALL, name, QUERIES[name], SQL[name], con)
    assert r["columns_match"], r
    assert r["spark_rows"] == r["duck_rows"], r
    assert r["values_match"], r
    assert not r["type_diffs"], r


def test_every_query_has_a_twin_or_is_ml():
    rows_only = set(QUERIES) - set(SQL)
    assert rows_only == {"tree_importance", "price_gbt_metrics", "price_gbt_predictions"}


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "month" in df.columns
