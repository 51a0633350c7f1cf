"""The corpus queries against their DuckDB SQL, over whole tables."""

import duckdb
import pytest

from auditlake.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    theirs = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in theirs.description]
    ours = queries.queries()[name](spark, SF)
    assert sorted(ours.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, ours.select(*columns).collect()))) == sorted(map(repr, theirs.fetchall()))
