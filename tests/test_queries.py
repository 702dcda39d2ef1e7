"""Every named query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import ENTRY_DATA, entry, oracle_sql, queries
from checking import compare, duck


@pytest.fixture(scope="module")
def con():
    return duck(ENTRY_DATA)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    rows, verdict, _ = compare(spark, con, ENTRY_DATA, name, queries()[name], oracle_sql().get(name))
    assert verdict in ("ok", "rows only")
    assert rows > 0


def test_entry(spark):
    assert entry(spark).count() > 0
