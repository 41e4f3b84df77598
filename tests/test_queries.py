from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from rasterflux.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = list(catalogue.QUERIES)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x != x:
        return "null"
    if isinstance(x, float):
        return round(x, 6) + 0.0
    return x


def test_entry(spark):
    assert entry.entry(spark).count() == 4096


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    sql = entry.oracle_sql().get(name)
    if not sql:
        assert got
        return
    rel = db.sql(sql)
    at = [rel.columns.index(c) for c in sorted(df.columns)]
    assert sorted(rel.columns) == sorted(df.columns)
    want = sorted((tuple(plain(r[k]) for k in at) for r in rel.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("keep", ["false", "l_orderkey = 0", "l_orderkey % 64 = 3"])
def test_cumulative_timeline_of_few_or_no_regions_equals_its_sql(spark, tmp_path, keep):
    """A step that shows no region has no row."""
    con = duckdb.connect()
    con.sql(f"copy (select * from '/root/testdata/sf0.01/lineitem.parquet' where {keep}) to '{tmp_path}/lineitem.parquet'")
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    got = sorted(tuple(r) for r in entry.queries()["timeline_cumulative"](spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(entry.oracle_sql()["timeline_cumulative"]).fetchall())
