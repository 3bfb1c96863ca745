"""Every query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from grovespark.plans.catalogue import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


def rows(frame):
    names = sorted(frame.columns)
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, (int, float)) else v
    return names, sorted((tuple(clean(getattr(v, "item", lambda v=v: v)()) for v in r) for r in frame[names].itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, tables, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(tables.sql(SQL[name]).df())


def test_entry_imports(spark):
    import __spark_entry__ as entry

    assert set(SQL) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).columns == ["cloud_id", "view", "row", "col", "value"]
