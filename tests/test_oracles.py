"""Every query with SQL gives DuckDB's rows on the smallest tables; the others give rows."""

from collections import Counter

import duckdb
import pytest

from waymark.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = Counter(tuple(r) for r in df.select(*sorted(df.columns)).collect()) if name in catalog.SQL else Counter({(): df.count()})
    assert sum(got.values())
    if name in catalog.SQL:
        r = duck.execute(catalog.SQL[name])
        names = [d[0] for d in r.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        assert sorted(df.columns) == sorted(names)
        assert got == Counter(tuple(row[i] for i in order) for row in r.fetchall())
