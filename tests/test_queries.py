"""Every query of the document operators against its SQL in DuckDB, over sf0.001."""

import math

import duckdb
import pytest

from paperloom.plans import queries as plans

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return tuple(map(norm, value)) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, duck, name):
    found = plans.QUERIES[name](spark, DIR)
    cols = sorted(found.columns)
    rows = sorted((tuple(norm(r[c]) for c in cols) for r in found.collect()), key=repr)
    if name not in plans.ORACLE:
        return
    asked = duck.execute(plans.ORACLE[name])
    names = [d[0] for d in asked.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == sorted((tuple(norm(r[k]) for k in at) for r in asked.fetchall()), key=repr)
