"""Every query with SQL gives the same rows as the SQL."""

from __future__ import annotations

import pytest

from narracode.catalog import all_oracles, all_queries
from tools.check_oracle import compare, oracle_connection

QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def con(sf):
    return oracle_connection(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf, con, name):
    got = QUERIES[name](spark, sf).toPandas()
    want = con.execute(ORACLES[name]).fetchdf()
    assert compare(got, want) == "ok"


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    import __spark_entry__ as entry_module

    assert entry_module.entry(spark).count() == 2
