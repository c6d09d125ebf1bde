"""Every query of the rail model against its SQL in DuckDB, and the contract of the entry module."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from railweave.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    found.execute("SET TimeZone='UTC'")
    for name in os.listdir(SF):
        found.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return found


def told(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    return [told(x) for x in value] if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    frame = queries.QUERIES[name](spark, SF)
    if name not in queries.ORACLE_SQL:
        assert frame.count() > 0
        return
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(frame.columns)
    rows = lambda found: sorted((told(list(r)) for r in found), key=repr)
    assert rows(frame.select(*names).collect()) == rows(want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
