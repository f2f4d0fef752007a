"""Registered queries give the rows that DuckDB gives for their SQL; the others run.

The fast ones run by default, all of them with ``ALL_QUERIES=1``. ``python -m checks.compare
sf0.01`` runs everything on a larger scale.
"""

import os

import pytest

import __spark_entry__ as registry
from checks.compare import connect, mismatch

QUERIES = {k: v for family in registry.FAMILIES for k, v in family.QUERIES.items()}
ORACLE = {k: v for family in registry.FAMILIES for k, v in family.ORACLE.items()}
SLOW = set() if os.environ.get("ALL_QUERIES") else {
    "knn_impute", "knn_impute_distance", "impute_by_config", "imputation_summary", "lof",
    "prepare_readings", "prepare_report", "rolling_features_cut", "rolling_features_global",
    "correlation_spearman_cut", "zscore_rolling_hours_cut", "rf_impute", "training_history",
    "hyperparameter_search", "model_leaderboard",
}


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(set(ORACLE) - SLOW))
def test_same_rows_as_sql(spark, sf, duck, name):
    assert mismatch(QUERIES[name](spark, sf), duck, ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - SLOW))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    df = registry.entry(spark)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
