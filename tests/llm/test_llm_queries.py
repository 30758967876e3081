"""The registered queries of this subpackage on the smallest tables, against their SQL where there is one."""

import os

import pytest

from tidewright.llm.queries import queries
from tidewright.llm.sql import oracle_sql

BASE = os.environ.get("TIDEWRIGHT_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no tables")
COLUMNS = {
    "p1_found": ["shipment_id", "neighbour_id"], "p2_found": ["shipment_id", "cluster_id"], "p3_found": ["rep_id", "id"], "p4_found": ["id_a", "id_b"],
    "p5_found": ["split", "category_name"], "p6_found": ["doc_id"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "pii_type", "start_char"],
}


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    df = queries()[name](spark, BASE)
    rows = [tuple(r) for r in df.collect()]
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(rows) == len(set(rows))
    if name in oracle_sql():
        duckdb = pytest.importorskip("duckdb")
        c = duckdb.connect()
        for f in os.listdir(BASE):
            c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{BASE}/{f}'")
        want = c.execute(oracle_sql()[name])
        cols = [d[0] for d in want.description]
        assert sorted(cols) == sorted(df.columns)
        order = [df.columns.index(x) for x in cols]
        assert sorted(str(tuple(r[i] for i in order)) for r in rows) == sorted(str(tuple(r)) for r in want.fetchall())
