"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from compare import compare, duck

import __spark_entry__ as driver

FOLDER = "/root/testdata/sf0.001"
SQL = driver.oracle_sql()
# trained in test_learning
TRAINED = {"model_metrics", "model_importances", "model_impact", "model_attributions", "model_folds"}


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", [n for n in driver.queries() if n not in TRAINED])
def test_query(spark, con, name):
    assert compare(spark, con, name, driver.queries()[name], SQL.get(name), FOLDER) is None


def test_entry(spark):
    df = driver.entry(spark)
    assert "equity_risk_class" in df.columns
    assert df.count() >= 1
