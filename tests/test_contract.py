"""Every registered query against its oracle on the smallest tables."""

from __future__ import annotations

import decimal
import glob
import math
import os

import pytest

from pairforge.plans import battery

duckdb = pytest.importorskip("duckdb")


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else int(v) if v.is_integer() else round(v, 7)
    return v


@pytest.fixture(scope="module")
def oracle(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: str([(x is None, str(x)) for x in r]))


@pytest.mark.parametrize("name", sorted(battery.QUERIES))
def test_query(spark, data, oracle, name):
    df = battery.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = ordered([tuple(plain(r[c]) for c in columns) for r in df.collect()])
    if name not in battery.ORACLE_SQL:
        assert got
        return
    cursor = oracle.execute(battery.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    want = ordered([tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()])
    assert sorted(names) == columns
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 8
    assert set(e.oracle_sql()) <= set(e.queries())
