from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from quireflow.llm import queries as llm

SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["field", "row_id"],
    "p2_found": ["field", "row_id", "end_pos"],
    "p3_found": ["field", "row_a", "row_b"],
    "p4_found": ["vec_a", "vec_b"],
    "p5_found": ["row_id", "field", "kind"],
    "p6_found": ["row_a", "row_b", "field"],
    "p7_ids": ["doc_id", "ids"],
    "p8_found": ["doc_id", "item_id"],
    "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    df = entry.queries()[name](spark, SMALL)
    assert df.columns == COLUMNS[name]
    rows = df.collect()
    assert len(rows) == len({str(r) for r in rows})
    if "row_b" in df.columns:
        assert all(r.row_a < r.row_b for r in rows)
    if name == "p4_found":
        assert all(r.vec_a < r.vec_b for r in rows)


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("dataset_info", "rulebase_chunkforpdf", "databuildt", "documents", "heldout_examples"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = llm.queries()[name](spark, SMALL)
    found = con.execute(llm.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(found.fetchall())
