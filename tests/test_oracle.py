"""Every query against its SQL on the smallest tables."""

import re

import pytest

import __spark_entry__ as entry
from checks.compare import compare, oracle_connection

SF = "/root/testdata/sf0.001"
#: The text operators have tests of their own.
NAMES = sorted(n for n in entry.queries() if n != "pipeline" and not re.match(r"op\d+_", n))


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


def test_every_query_has_sql():
    assert set(NAMES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    ok, _, _, message = compare(spark, con, SF, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, message
