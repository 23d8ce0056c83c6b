"""The training-data queries with SQL give DuckDB's rows on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from waymark.llm import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, name):
    c = duckdb.connect()
    for t in "documents pages labels benchmark".split():
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = registry.QUERIES[name](spark, DATA)
    got = Counter(tuple(r) for r in df.select(*sorted(df.columns)).collect())
    r = c.execute(registry.SQL[name])
    names = [d[0] for d in r.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert sorted(df.columns) == sorted(names) and got
    assert got == Counter(tuple(row[i] for i in order) for row in r.fetchall())
