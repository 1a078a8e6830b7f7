"""Every registered query with SQL gives the SQL's rows."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.compare import TABLES, canon

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, FOLDER)
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    assert got[1]
    if name in oracle_sql():
        cur = duck.execute(oracle_sql()[name])
        assert got == canon([c[0] for c in cur.description], cur.fetchall())


def test_entry(spark):
    assert entry(spark).count() > 0
