"""Every registered query on the smallest tables against its SQL."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare
from tableprobe.queries import QUERIES
from tests.conftest import SMALL

# These train models or run a fleet of profiles; they have tests of their own.
SLOW = {"meta_model_report", "multiclass_baseline", "regression_baseline", "binary_baseline"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, duck, name):
    status, detail = compare(spark, duck, name, SMALL)
    assert status in ("match", "rows-only"), detail


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    rows = entry(spark).collect()
    assert rows and {"rule_code", "severity"} <= set(rows[0].asDict())
