"""Every query of the library proper runs, and those with SQL give its rows."""

import os

import duckdb
import pytest

from riskloom import plans

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = plans.queries(), plans.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.sql(f"create view {name.split('.')[0]} as select * from '{FOLDER}/{name}'")
    return con


def plain(rows):
    def text(v):
        return f"{v:.4f}" if isinstance(v, float) and v == v else "null" if v is None or v != v else str(v)

    return sorted(tuple(text(v) for v in r) for r in rows)


def close(a, b):
    if len(a) != len(b):
        return False
    for x, y in zip(a, b, strict=True):
        for v, w in zip(x, y, strict=True):
            if v != w:
                try:
                    if abs(float(v) - float(w)) > 2e-4 * max(1, abs(float(w))):
                        return False
                except ValueError:
                    return False
    return True


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, tables, name):
    df = QUERIES[name](spark, FOLDER)
    rel = tables.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = sorted(df.columns)
    want = rel.project(", ".join(f'"{c}"' for c in order)).fetchall()
    assert close(plain(df.select(*order).collect()), plain(want))


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_runs(spark, name):
    """Those without SQL give rows under a schema that no row contradicts."""
    df = QUERIES[name](spark, FOLDER)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns) and all(len(r) == len(df.columns) for r in rows)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
