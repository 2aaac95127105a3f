"""The training-data queries that have SQL give what DuckDB gives on the same tables."""

import os

import duckdb
import pytest

pytest.importorskip("public_tokenizers")
from tessellate.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    got = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = con.execute(f"select {', '.join(columns)} from ({queries.ORACLE[name]})")
    assert sorted(c[0] for c in want.description) == columns
    plain = lambda rows: sorted(tuple(map(repr, r)) for r in rows)
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(want.fetchall())
