from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from quireflow import queries as core

SMALL = "/root/testdata/sf0.001"
TABLES = ("dataset_info", "rulebase_chunkforpdf", "retrieval_tokenizer", "databuildt", "documents", "heldout_examples", "embeddings")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    df = core.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    found = duck.execute(core.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert plain(tuple(r[c] for c in columns) for r in df.collect()) == plain(tuple(r[names.index(c)] for c in columns) for r in found.fetchall())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r.input_text.startswith("summarize: question: ") for r in rows)
    per_paper = {}
    for r in rows:
        per_paper.setdefault(r.paper_id, []).append(r.sample_type)
    assert all(sorted(kinds) in (["clean"], ["clean", "noisy"]) for kinds in per_paper.values())


def test_every_query_is_named(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
