"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from sitefold.plans import queries as plans
from sitefold.plans.flagship import reconcile_everything

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


def rows(frame):
    def one(v):
        if v is None or str(v) in ("NaT", "None", "<NA>", "nan"):
            return ""
        return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(one, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.sql(SQL[name]).df())


def test_flagship_has_one_row_per_object(spark):
    got = reconcile_everything(spark, DATA).toPandas()
    assert len(got) and not got.duplicated(["bucket", "name"]).any()
