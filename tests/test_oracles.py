"""Every query of the library proper against its SQL counterpart, or for its rows where SQL has none."""

from __future__ import annotations

import pytest

from loomstone.plans.registry import ORACLES, QUERIES
from oracle import connect, differences


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, con, name):
    assert differences(QUERIES[name](spark, sf), con, ORACLES[name]) == ([], [])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
