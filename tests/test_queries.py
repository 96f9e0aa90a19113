"""Every query with an SQL twin against DuckDB on the smallest test tables; the others have to give rows (second readings: test_second_readings)."""

import glob
import os

import pytest

from isotrek.plans import catalog

DATA = os.environ.get("ISOTREK_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


def normal(columns, table):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("~" if r[i] is None else repr(r[i]) if isinstance(r[i], float) else str(r[i]) for i in order) for r in table)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    want = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert normal(df.columns, map(tuple, df.collect())) == normal(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    df = catalog.queries()[name](spark, DATA)
    assert df.columns and len(df.collect()) > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and catalog.FLAGSHIP in e.queries()
