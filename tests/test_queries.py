"""Every query with SQL gives the rows of its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from sondeur.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "conversations", "events", "orders")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(rows):
    return sorted((tuple(round(float(v), 5) if isinstance(v, float) and not math.isnan(v) else int(v) if isinstance(v, bool) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, db, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = db.sql(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({queries.ORACLES[name]})").fetchall()
    assert plain(map(tuple, got.select(*[f"`{c}`" for c in columns]).collect())) == plain(want)
