"""Every registered query gives the rows of its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import DATA, compare, connect

SF = os.environ.get("TEST_SF", "0.001")
EXTRA = entry._optional()[0]  # these have tests of their own
QUERIES = {name: fn for name, fn in entry.queries().items() if name not in EXTRA}
SQL = {name: sql for name, sql in entry.oracle_sql().items() if name not in EXTRA}


@pytest.fixture(scope="module")
def con():
    return connect(f"{DATA}/sf{SF}")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    sf_dir = f"{DATA}/sf{SF}"
    if name in SQL:
        assert compare(spark, con, name, QUERIES[name], SQL[name], sf_dir) == ""
    else:
        assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["repo", "dir", "files", "lines", "bytes", "tokens"]
    assert df.filter("dir = ''").count() > 0


def test_only_known_queries_lack_sql():
    assert set(QUERIES) == set(SQL)
