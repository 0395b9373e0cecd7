"""Every report against its SQL counterpart on the smallest supplied tables."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect
from checks.sql import ORACLE
from tests.conftest import SMALL
from wareflow.plans.catalog import REPORTS


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_report_has_a_counterpart():
    assert set(REPORTS) == set(ORACLE)
    assert set(REPORTS) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(REPORTS))
def test_equal(spark, con, name):
    ok, note = compare(spark, con, SMALL, name)
    assert ok, note


def test_entry_is_the_flagship(spark):
    assert entry.entry(spark).count() == 14  # two territories have sales at this size
