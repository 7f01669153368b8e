"""Queries with SQL give DuckDB's rows."""

import duckdb
import pytest

from trussline.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, rel = QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    names = sorted(df.columns)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    want = sorted((tuple(r[rel.columns.index(c)] for c in names) for r in rel.fetchall()), key=repr)
    assert got == want
