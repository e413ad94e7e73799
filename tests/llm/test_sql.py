"""The queries that SQL can express, on the smallest tables."""

import duckdb
import pytest

from factloom.llm import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    r = con.execute(registry.ORACLE_SQL[name])
    at = [[d[0] for d in r.description].index(c) for c in cols]
    assert sorted((tuple(x[c] for c in cols) for x in df.collect()), key=repr) == sorted((tuple(x[i] for i in at) for x in r.fetchall()), key=repr)
