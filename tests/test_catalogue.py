"""Every catalogue query against its DuckDB SQL on the smallest test tables."""

import datetime as dt
import math
import os
from pathlib import Path

import duckdb
import pytest

from semlake.plans import catalogue

DATA = Path(os.environ.get("SEMLAKE_TEST_DATA", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool) or isinstance(value, (str, bytes, dt.date)):
        return str(value)
    return round(float(value), 6)


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([plain(v[i]) for i in order]) for v in values)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, str(DATA))
    if name not in catalogue.ORACLES:
        assert got.count() > 0
        return
    cursor = duck.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, cursor.fetchall())
