"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest

from compare import connect, difference
from conftest import SF_DIR
from recordmill.testbed.oracle import ORACLE
from recordmill.testbed.registry import QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLE)))
def test_query(spark, con, name):
    assert difference(spark, con, SF_DIR, name) is None


def test_every_twin_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.queries()) >= set(QUERIES)
