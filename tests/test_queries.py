"""Every registered query runs on the smallest tables, and has the columns of its SQL."""

import os

import pytest

import __spark_entry__ as entry
from tidewright.plans.queries import queries

BASE = os.environ.get("TIDEWRIGHT_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no tables")


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a == b or (a is not None and b is not None and abs(float(a) - float(b)) < 1e-6)
    return str(a).replace("+00:00", "") == str(b).replace("+00:00", "")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(BASE):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{BASE}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, BASE)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if not sql:
        assert df.columns
        return
    want = duck.execute(sql)
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(df.columns)
    order = lambda c: sorted(range(len(c)), key=lambda i: c[i])
    key = lambda t: tuple(round(float(x), 5) if isinstance(x, float) else str(x).replace("+00:00", "") for x in t)
    a = sorted((tuple(r[i] for i in order(df.columns)) for r in rows), key=lambda t: tuple(map(str, key(t))))
    b = sorted((tuple(r[i] for i in order(cols)) for r in want.fetchall()), key=lambda t: tuple(map(str, key(t))))
    assert len(a) == len(b) and all(same(x, y) for r, s in zip(a, b) for x, y in zip(r, s))
