"""Every registered query against its SQL on the smallest driver tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import check_oracle as C  # noqa: E402
from sparkrag.catalog import load  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in C.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = C.rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert name in ORACLES, "every query needs its SQL"
    cur = duck.execute(ORACLES[name])
    assert got == C.rows_of([d[0] for d in cur.description], cur.fetchall())
