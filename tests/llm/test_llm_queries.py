"""The queries that SQL can say, against DuckDB over sf0.001."""

import duckdb
import pytest

from paperloom.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    found = queries.QUERIES[name](spark, DIR)
    asked = con.execute(queries.ORACLE[name])
    names = [d[0] for d in asked.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted((tuple(r[n] for n in names) for r in found.collect()), key=repr) == sorted(asked.fetchall(), key=repr)
