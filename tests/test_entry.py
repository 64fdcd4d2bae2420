import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from stocktake import catalog


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{sf}/{f}')")
    return con


def plain(rows):
    norm = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(str([norm(v) for v in r]) for r in rows)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(catalog.SQL) == set(catalog.QUERIES) and set(catalog.QUERIES) <= set(entry_point.queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows_as_sql(spark, duck, sf, name):
    df = entry_point.queries()[name](spark, sf)
    found = duck.execute(entry_point.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain([[r[c] for c in columns] for r in df.collect()]) == plain(found.fetchall())
