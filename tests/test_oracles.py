"""Every registered query with SQL gives the same rows as DuckDB."""

import pytest

import __spark_entry__ as se
from check_oracles import compare, duck

SLOW = {"m05_lasso", "m06_random_forest", "m07_gradient_boost", "m08_staged_search", "m08_search_scores", "m13_layer_features", "m16_all_models", "m16_author_models"}


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(set(se.queries()) - SLOW))
def test_query(spark, con, sf, name):
    text, _, ok = compare(spark, con, name, sf)
    assert ok, text


def test_oracles_are_queries():
    assert set(se.oracle_sql()) <= set(se.queries())


def test_entry_regression(spark):
    rows = {r["horizon"]: r for r in se.entry(spark).collect()}
    assert rows[1]["n_rows"] == 40
    assert round(rows[1]["mape"], 6) == 0.037394 and round(rows[1]["se"], 6) == 0.004517
    assert round(rows[10]["mape"], 6) == 0.104765 and round(rows[10]["se"], 6) == 0.013803
