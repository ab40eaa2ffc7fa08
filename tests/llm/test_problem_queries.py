import duckdb
import pytest

from tidemark.llm.oracle import ORACLE
from tidemark.llm.queries import QUERIES

TABLES = ["recall_candidates", "memory_fragments", "store_requests", "warm_vectors", "documents", "mix_targets"]
COLUMNS = {
    "p1_found": ["namespace", "fragment_id"], "p2_found": ["fragment_a", "fragment_b"], "p3_found": ["record_kind", "record_id"],
    "p4_found": ["fragment_a", "fragment_b"], "p5_found": ["doc_id"], "p6_found": ["source"], "p7_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = sorted(map(tuple, df.collect())) if name in ORACLE else df.count()
    if name not in ORACLE:
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cols = ", ".join(df.columns)
    assert rows == sorted(con.execute(f"SELECT {cols} FROM ({ORACLE[name]})").fetchall())
