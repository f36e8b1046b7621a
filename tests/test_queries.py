"""All queries with SQL against it on the smallest tables; verify.py does so on larger ones."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from verify import plain

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(entry.oracle_sql())


def test_catalogue():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(sql) > 100


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in sorted(os.listdir(FOLDER)):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    mine = Counter(tuple(plain(x) for x in r) for r in df.select(*columns).collect())
    rel = con.sql(entry.oracle_sql()[name])
    assert columns == sorted(rel.columns)
    theirs = Counter(tuple(plain(x) for x in r) for r in rel.select(*[f'"{c}"' for c in columns]).fetchall())
    assert mine == theirs


def test_empty_tables(spark, tmp_path):
    """Every query runs over tables without rows."""
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    for f in os.listdir(FOLDER):
        spark.read.parquet(f"{FOLDER}/{f}").limit(0).write.parquet(str(tmp_path / f))
    for name, query in entry.queries().items():
        assert query(spark, str(tmp_path)).count() <= 6, name  # values asked for and totals have rows of their own
