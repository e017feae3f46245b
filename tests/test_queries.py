"""Every query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from marginalia.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if hasattr(value, "isoformat"):
        return str(value)
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = sorted([[plain(r[c]) for c in cols] for r in df.collect()], key=repr)
    if name not in SQL:
        return
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == cols
    want = sorted([[plain(dict(zip(rel.columns, r, strict=True))[c]) for c in cols] for r in rel.fetchall()], key=repr)
    assert found == want
