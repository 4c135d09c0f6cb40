"""Every tenth mesh query against its SQL; the driver runs them all."""

import glob

import pytest

import __spark_entry__ as entry
from stratamesh.plans import queries as mesh

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not glob.glob(f"{DATA}/*.parquet"), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(mesh.oracle_sql())[::10])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = mesh.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    expected = con.sql(mesh.oracle_sql()[name])
    at = [expected.columns.index(c) for c in columns]
    assert sorted(tuple(map(repr, r)) for r in df.select(*columns).collect()) == sorted(tuple(repr(r[i]) for i in at) for r in expected.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 2
