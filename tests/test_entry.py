"""Every registered query of the library itself against its SQL on the smallest tables."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from pulsegrid.plans import queries as own

SLOW = {"components", "main_network"}  # tests/test_network.py holds both operators against plain Python


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return con


def plain(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    one = lambda v: "null" if v is None or v != v else repr(v + 0.0) if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else repr(v)
    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", [n for n in own.QUERIES if n in own.SQL and n not in SLOW])
def test_query_equals_its_sql(spark, sf_dir, tables, name):
    df = own.QUERIES[name](spark, sf_dir)
    cursor = tables.execute(own.SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert plain(df.collect(), df.columns) == plain(cursor.fetchall(), names)


@pytest.mark.parametrize("name", [n for n in own.QUERIES if n not in own.SQL and n not in SLOW])
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert own.QUERIES[name](spark, sf_dir).count() > 0


def test_import_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(entry.__file__), check=True, timeout=120)


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(own.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert math.isfinite(len(entry.queries()))
