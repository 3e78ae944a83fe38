"""Registered corpus queries against their DuckDB SQL at the smallest scale."""

import duckdb
import pytest

import corpus_pipeline
from tideline.llm import catalog

SMOKE_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE_DIR}/{t}.parquet')")
    got = catalog.QUERIES[name](spark, SMOKE_DIR)
    cols = sorted(got.columns)
    want = con.execute(f"select {', '.join(cols)} from ({catalog.ORACLE_SQL[name]})").fetchall()
    assert sorted((tuple(r) for r in got.select(*cols).collect()), key=repr) == sorted(want, key=repr)


def test_every_operator_is_registered_once():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_dedup", "suffix_dedup", "packing"]
