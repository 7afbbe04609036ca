"""Queries that take all rows of their tables, against their SQL on the smallest ones."""

import os

import pytest

from tests import test_oracle as oracle

NAMES = ["join_10_asof_backward", "join_11_asof_forward", "join_12_events_in_hold", "join_13_hold_classes", "join_15_next_event_offset"]
DIR = oracle.DIR


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    oracle.test_query(spark, name)
