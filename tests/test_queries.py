"""Every query against its SQL on the smallest tables."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parents[1], timeout=120)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_gives_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["target", "word", "n"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    assert compare(spark, FOLDER, name, QUERIES[name], SQL[name], duck) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, duck, name):
    assert compare(spark, FOLDER, name, QUERIES[name], None, duck) is None
