"""Every reference query against its SQL in another engine, on the smallest driver tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest

from cryoframe.plans import registry


def _plain(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return "NULL"
    if isinstance(x, float):
        return str(int(x)) if x == int(x) else repr(round(x, 9))
    if hasattr(x, "isoformat"):
        return x.isoformat().replace("T", " ")[:19].removesuffix(" 00:00:00")
    return str(x)


def _rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple(_plain(x) for x in row) for row in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, folder, duck, name):
    got = registry.QUERIES[name](spark, folder).toPandas()
    if name in registry.ORACLE_SQL:
        expected = duck.sql(registry.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(expected.columns)
        assert _rows(got) == _rows(expected)
    else:
        assert len(got.columns)


def _against_sql(spark, tmp_path, name, **tables):
    """A query and its SQL over small tables of their own."""
    con = duckdb.connect()
    for table, df in tables.items():
        df.write.parquet(f"{tmp_path}/{table}.parquet")
        con.sql(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    got = _rows(registry.QUERIES[name](spark, str(tmp_path)).toPandas())
    assert got == _rows(con.sql(registry.ORACLE_SQL[name]).df())
    return got


def test_age_counts_whole_seconds_of_the_clock(spark, tmp_path):
    # a day and half a second: 86,401 seconds of the clock
    events = spark.sql("select id as event_id, timestamp_micros(1706572798000000 + id * 500000) as ts from range(5)")
    assert len(_against_sql(spark, tmp_path, "f19_age_filter", events=events)) == 4


def test_grids_that_only_touch_a_footprint_are_covered(spark, tmp_path):
    # plot 45: the least x is 600, on a line of the grid
    supplier, customer = spark.sql("select 45L as s_suppkey"), spark.sql("select 1L as c_custkey, 1D as c_acctbal")
    _against_sql(spark, tmp_path, "p12_region_orchestration", supplier=supplier, customer=customer)
