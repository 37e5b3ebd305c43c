"""Every registered query against its DuckDB text on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.oracle import difference, duck

SF_DIR = "/root/testdata/sf0.001"
QUERIES = entry.queries()
CHECKS = entry.oracle_sql()


# Queries whose result is empty on the smallest tables on purpose.
EMPTY: frozenset[str] = frozenset()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in CHECKS:
        assert difference(df, con, CHECKS[name]) is None
        rows = con.execute(f"SELECT count(*) FROM ({CHECKS[name]})").fetchone()[0]
        assert rows > 0 or name in EMPTY, "an empty result checks nothing"
    else:
        assert df.count() > 0


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
