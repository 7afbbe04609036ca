"""Tables and workers over all rows, against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests import test_oracle as oracle

NAMES = ["agg_27_crosstab", "ctrl_06_fold_workers"]
DIR = oracle.DIR


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    oracle.test_query(spark, name)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
def test_all_rows(spark):
    orders = spark.read.parquet(f"{DIR}/orders.parquet").count()
    q = entry.queries()
    fisher = q["agg_27_fisher_exact"](spark, DIR).first()
    whole = q["agg_27_crosstab"](spark, DIR).first()
    assert [fisher[c] for c in "abcd"] == [whole[c] for c in "abcd"] and 0 <= fisher["p"] <= 1
    assert sum(fisher[c] for c in "abcd") == orders and q["ctrl_06_fold_workers"](spark, DIR).count() == orders
